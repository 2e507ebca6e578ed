"""Event programs and their text form.

A program is a sequence of steps; a step is a conjunction of predicates over object variables that holds for at least
`duration` consecutive frames. Text: `Duration((Far(o0, o1, 3.0), Red(o0)), 5); Near(o0, o1, 1.0)`. Older spellings
with the parameter in the name (`Near_1.0(o0, o1)`, `Color_red(o0)`) and with nested `Conjunction(a, b)` are
read as well. A parameter of 0 is a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from segmenta.functions.predicates import PREDICATES


@dataclass(frozen=True)
class Atom:
    name: str
    variables: tuple[str, ...]
    parameter: float | str | None = None

    def __str__(self) -> str:
        shown = [] if self.parameter is None else [f"'{self.parameter}'" if isinstance(self.parameter, str) else str(self.parameter)]
        return f"{self.name}({', '.join([*self.variables, *shown])})"


@dataclass(frozen=True)
class Step:
    atoms: tuple[Atom, ...]
    duration: int = 1

    def __str__(self) -> str:
        inner = ", ".join(map(str, self.atoms))
        if len(self.atoms) > 1:
            inner = f"({inner})"
        return f"Duration({inner}, {self.duration})" if self.duration > 1 else inner

    @property
    def variables(self) -> list[str]:
        return sorted({v for a in self.atoms for v in a.variables}, key=lambda v: int(v[1:]))


Program = tuple[Step, ...]

_ATOM = re.compile(r"([A-Za-z]\w*?)(?:_([\w.]+))?\(((?:\s*o\d+\s*,?)+)\s*(?:,?\s*('[^']*'|\"[^\"]*\"|[-+.\deE]+))?\s*\)")


def _value(text: str | None) -> float | str | None:
    if not text:
        return None
    if text[0] in "'\"":
        return text[1:-1]
    try:
        return float(text)
    except ValueError:
        return text


def _atom(m: re.Match) -> Atom:
    name, suffix, variables, last = m.groups()
    if suffix and f"{name}_{suffix}".lower() in PREDICATES:
        name, suffix = f"{name}_{suffix}", None
    known = PREDICATES.get(name.lower())
    return Atom(known.name if known else name, tuple(re.findall(r"o\d+", variables)), _value(last if last is not None else suffix))


def program_of(text: str) -> Program:
    """The program that a text spells."""
    steps = []
    for part in re.split(r";\s*", text.strip()):
        duration, body = 1, part.strip()
        if m := re.fullmatch(r"Duration\((.*),\s*(\d+)\)", body, re.S):
            body, duration = m[1], int(m[2])
        atoms = tuple(_atom(m) for m in _ATOM.finditer(body))
        left = _ATOM.sub("", body).replace("Conjunction", "")
        if not atoms or left.strip("(), \n"):
            raise ValueError(f"not a step: {part!r}")
        steps.append(Step(atoms, duration))
    return tuple(steps)


def text_of(program: Program) -> str:
    return "; ".join(map(str, program))


def canonical(program: Program, free: bool = True, sort_variables: bool = True) -> Program:
    """The spelling that equal programs share: atoms sorted by name and variables, variables numbered by first
    appearance (free mode), and, if asked, sorted inside each atom. Sorting inside atoms merges mirrored predicates, as
    searches want; it is not for programs that are to be run."""
    out, names = [], {}
    for step in program:
        atoms = sorted(step.atoms, key=lambda a: f"{a.name} {' '.join(a.variables)}")
        if free:
            for a in atoms:
                for v in a.variables:
                    names.setdefault(v, f"o{len(names)}")
            atoms = [replace(a, variables=tuple(names[v] for v in a.variables)) for a in atoms]
        if sort_variables:
            atoms = [replace(a, variables=tuple(sorted(a.variables))) for a in atoms]
        out.append(Step(tuple(atoms), step.duration))
    return tuple(out)


def cost(program: Program, unit: int = 5) -> float:
    """Complexity: predicates, and for each unit of duration one and a tenth of the step's predicates."""
    return sum(len(s.atoms) + s.duration // unit * (1 + 0.1 * len(s.atoms)) for s in program)

"""Secret spans against plain definitions of the patterns and of the guess cost."""

import hashlib
import math
import random
import re
import resource

import pytest
from conftest_llm import EDGES

from segmenta.llm import secrets

FEW = {"password": 1, "dragon": 2, "pass": 3, "word": 4, "sun": 5, "agon": 6}


@pytest.fixture(scope="module")
def public():
    return secrets.Guesser(secrets.ranked_words())


def classes(part):
    return math.log10(math.prod(10 if c in "0123456789" else 26 if c.lower() != c.upper() else 33 for c in part))


def is_run(value, i, j, p):
    inside = all(value[k] == value[k + p] for k in range(i, j - p))
    longer = (i > 0 and value[i - 1] == value[i - 1 + p]) or (j < len(value) and value[j] == value[j - p])
    return inside and not longer and (j - i >= 3 * p or (j - i >= 2 * p and j - i >= 6))


def plain_cost(value, words):
    """The least cost over every cut of value, each span priced by what it is."""
    low = value.lower()
    leet = "".join({"@": "a", "4": "a", "3": "e", "0": "o", "1": "i", "5": "s", "7": "t", "$": "s", "!": "i"}.get(c, c) for c in low)

    def price(i, j):
        options = [classes(value[i:j])]
        cased = 1 if value[i:j].islower() else 2
        options += [math.log10(2 * words[low[i:j]] * cased)] if low[i:j] in words else []
        options += [math.log10(4 * words[leet[i:j]] * cased)] if leet[i:j] in words else []
        if value[i:j] in DATES:
            options.append(math.log10(43800 if j - i > 4 else 120))
        for row in secrets.WALKS:
            if j - i >= 3 and (low[i:j] in row or low[i:j] in row[::-1]):
                options.append(math.log10(len(secrets.WALKS) * len(row) * 2 * (j - i)))
        options += [classes(value[i : i + p]) + math.log10((j - i) / p) for p in range(1, (j - i) // 2 + 1) if is_run(low, i, j, p)]
        return min(options)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + price(i, j) + (math.log10(2) if i else 0) for i in range(j)))
    return best[-1]


DATES = {"2019-12-31", "1999", "31.12.99", "20200101"}


def test_guess_cost_against_all_cuts():
    rng = random.Random(3)
    own = secrets.Guesser(FEW)
    values = ["password1", "Xk9#qL2v", "aaaaaaaa", "qwertyuiop", "2019-12-31", "P4ssw0rd!dragon", "abcabcabc", "a", "Sunsunsun", "x1999x", "31.12.99!", "poiuytQWER", "*" * 40, "ab" * 50 + "c", "ſunſun"]
    values += ["".join(rng.choices([*"adgkopqrs@#-", "pass", "word", "sun", "dragon", "aa"], k=rng.randrange(1, 9))) for _ in range(80)]
    for v in values:
        assert own.cost(v) == pytest.approx(plain_cost(v, FEW)), v


def test_weak_and_strong_values(public):
    weak = ["password123", "P4ssw0rd!dragon", "2019-12-31", "qwertyuiop", "*" * 100, "hunter2hunter2", "abcabcabcabcabc", "monkey1999", "persistence"]
    strong = ["Zt7!kQ#9vLw2", "b7db7aa4a5fcc78305", "x9$kQ2!pz", "wJalrXUtnFEMI/K7MDENG", "9f!Gq-27Lz@m"]
    assert all(public.cost(v) < secrets.HARD for v in weak) and all(public.cost(v) >= secrets.HARD for v in strong)
    for v in strong:
        for context in ("password = '{}'", "smtpPass: {}", "mysqlPassword={}", "db_pin: {}", "the passphrase is {} here", 'AUTH_KEY => "{}"'):
            text = context.format(v)
            assert ("guess", v) in [(k, text[i:j]) for i, j, k in secrets.spans_of(text, public)], text
    for prose in ("The secret is persistence", "the token is understanding.", "a pin is permanently lost", "compass: Xk9#qL2vQ9", "the key is interesting", "password: changeme123", "my secret: wonderful"):
        assert secrets.spans_of(prose, public) == [], prose


def test_long_values_take_little_memory(public):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert public.cost("a" * 300_000) < 8
    assert public.cost("".join(random.Random(1).choices("abcXYZ019+/", k=100_000))) > 50_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB


def plain_base(text):
    """n_assign, n_access, n_hex and the digest, by the words of the contract."""
    text, spans = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, m.end())] if len(m.group(2)) >= 12 else []
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in sorted(spans))
    return (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(told.encode()).hexdigest())


def test_report(spark, docs_of):
    rng = random.Random(9)
    bits = ["password", "Token", "API_key", "apikey", "secret", "=", " : ", "'", '"', "AKIA", "ABCDEF012345", "0123456789abcdef", "deadbeef", "xyz", " ", "\n", "Ä", "😀", ".", "K", "ſ"]
    rows = [*EDGES, *[(100 + k, "".join(rng.choices(bits, k=rng.randrange(40)))) for k in range(300)], (50, "token = " + "k" * 60_000)]
    got = secrets.secret_report(docs_of(rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got])) == sorted(map(str, [(i, *plain_base(t)) for i, t, *_ in rows]))
    assert any(r.n_guess for r in got)
    assert secrets.secret_report(docs_of([])).collect() == []

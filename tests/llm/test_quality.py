"""Quality rules against plain counts, and planted junk."""

import base64
import math
import random
import re
from collections import Counter

import pytest
from conftest_llm import EDGES

from segmenta.llm import fertility

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOCK = {
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer".split(),
}


def brute_base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)


def test_base_counts(spark, docs_of):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "#", "\x1c", " ", "ü ", "\r"], k=rng.randrange(80))) for _ in range(80)]
    rows = EDGES + [(100 + k, t) for k, t in enumerate(texts)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = fertility.quality(docs_of(rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        b = brute_base(t or "")
        want[i, *b, b[0] < 10 or 100 * b[-1] > 20 * b[0]] += 1
    assert Counter((r.doc_id, *(r[n] for n in names), r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility.quality(docs_of([])).collect() == []


def plain_measures(text):
    """The three measures under both vocabularies, from the libraries' own pieces."""
    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARIES[0])
    pieces = sp.encode(text, out_type=str)
    blank = {f"<0x{b:02X}>" for b in b" \t\n\v\f\r"}
    bytes_of = [p.startswith("<0x") and p not in blank for p in pieces]
    with open(fertility.VOCABULARIES[1], "rb") as f:
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f}
    own = tiktoken.Encoding("own", pat_str=fertility.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode_ordinary(text)

    def broken(token):
        try:
            own.decode_single_token_bytes(token).decode()
        except UnicodeDecodeError:
            return True
        return False

    for tokens, fallback in ((pieces, bytes_of), (ids, [broken(i) for i in ids])):
        n = Counter(tokens)
        entropy = sum(-c / len(tokens) * math.log2(c / len(tokens)) for c in n.values())
        yield len(tokens), len(text) / len(tokens), sum(fallback) / len(tokens), entropy / math.log2(len(n)) if len(n) > 1 else 0


@pytest.mark.parametrize("text", ["Ein Satz, der 12 Zahlen\tund\nUmlaute wie öäü hat.", "字符 and 😀😀 ꙮ", "a", "x" * 500, "   "])
def test_measures(spark, docs_of, text):
    row = fertility.measured(docs_of([(1, text)])).first()
    for got, want in zip(row.fertility, plain_measures(text), strict=True):
        assert (got.tokens, got.chars, got.fallback, got.evenness) == pytest.approx(want)


def test_ids_are_those_of_the_library():
    """The piece vocabulary's merges as ranks give the library's ids, and texts of one- and two-byte characters take that way."""
    import sentencepiece

    rng = random.Random(8)
    bits = ["the", "Straße", "été ", "'s", "1234", "ꙮ", "字符", "😀", "##", "\u0301", "Ж", "ƀ", "x" * 40, *" " * 6, "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "▁", "\0", "-", "<s>", "<0x41>"]
    texts = ["", " ", "  ", "a ", " a", "▁", "▁ a", "a▁ b", "a ▁b", "a  b", "\0", "ab" * 5000, "".join(rng.choices("abcdé", k=3000))]
    texts += ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(1500)]
    prose = ["".join(c + " " * (c in "en") for c in rng.choices("abcdeiounrstäöüßéñ,.", k=300)) for _ in range(300)]
    path = fertility.VOCABULARIES[0]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size())]
    with open(path, "rb") as f:
        data = f.read()
    v, plain = fertility.Vocabulary(path, data), fertility._as_ranks(data, sp)
    for t in texts + prose + pieces:
        assert v.encode(t) == sp.encode(t), t
    assert all(plain(t) for t in prose) and plain("字") is None and plain("a  b") is None


def test_verdict(spark, docs_of):
    """Bands of two languages; junk of several kinds goes and prose of many lengths stays."""
    rng = random.Random(6)
    say = lambda lang, n: " ".join(rng.choices(STOCK[lang], k=n))
    prose = [(k, say(lang, rng.randrange(12, 300)), lang) for k, lang in enumerate(["en", "de"] * 150)]
    junk = {
        1000: " ".join(w + rng.choice(["###", "%%%", "&&&", "$$$"]) for w in rng.choices(STOCK["en"], k=150)),
        1001: " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(20)),
        1002: " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(100)),
        1003: "".join(chr(0x10000 + rng.randrange(5000)) + (" " if k % 9 == 0 else "") for k in range(400)),
        1004: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=12)) for _ in range(100)),
        1005: "".join(rng.choices(["aa ", "aa aa ab ", "ab "], weights=[1, 1, 60], k=12)) + " ".join(f"{w} a" for w in rng.sample(STOCK["en"], 90)).replace(" a ", " a a a a a a "),
    }
    docs = docs_of([*prose, *[(k, t, "en") for k, t in junk.items()]])
    got = {r.doc_id: r for r in fertility.quality(docs).collect()}
    assert all(got[k].kept and got[k].reasons == "" for k, *_ in prose)
    for k in (1000, 1001, 1002, 1003, 1004):
        assert not got[k].kept and not got[k].base_failed and got[k].reasons, k
    assert not got[1005].kept
    assert "fallback" in got[1003].reasons and "chars" in got[1000].reasons
    by_script = {r.doc_id: r for r in fertility.quality(docs, lang_col=None).collect()}
    assert not by_script[1001].kept and not by_script[1004].kept
    few = fertility.quality(docs_of(prose[:20])).collect()  # no group is large enough for bands
    assert all(r.kept for r in few)

"""Fill-in-middle, quality rules and tokenizer alignment against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import alignment, fim, quality
from sightline.llm.words import vocabulary_path

LONG = "a line of the very long text\nand its second line, again " * 20_000
ODD = [None, "", " ", "\n", "\n\n\n", "no line end", "one\n", "é\nü😀\r\nx", "has <P> in it\n", "a<\nP>b<S\n>", "<M", LONG]


# Fill-in-middle

def _expected_fim(doc_id, text, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_agrees_with_slicing_and_restores(make_docs):
    rows = [(i, t) for i in range(40) for t in ODD[:-1]] + [(1, LONG), (None, "no\nidentifier\n"), (1, LONG)]
    got = fim.restored(fim.transformed(make_docs(rows))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    seen = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert seen == Counter((i, *_expected_fim(i, t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n<PSM>é😀", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_fim_rotations_are_inverse(text, a, b, form):
    marks = [m.encode() for m in fim.MARKS]
    raw = text.encode()
    ends = fim.line_ends(raw)
    first, second = sorted((ends[a % len(ends)], ends[b % len(ends)]))
    if raw and not any(m in raw for m in marks):
        assert fim.rearrange(fim.arrange(raw, first, second, form, marks), form, marks) == raw


def test_fim_rates_and_marks(make_docs):
    docs = make_docs([(i, f"text {i}\nof\nlines\n") for i in range(400)])
    forms = Counter(r.form for r in fim.transformed(docs, percent=50, suffix_first_percent=20).collect())
    assert 150 < forms["plain"] < 250 and forms["psm"] > 2 * forms["spm"]
    other = fim.restored(fim.transformed(docs, marks=("[pre]", "[suf]", "[mid]")), marks=("[pre]", "[suf]", "[mid]"))
    assert all(r.restored == f"text {r.doc_id}\nof\nlines\n" and "[pre]" in r.output for r in other.collect())
    for marks in (("<P>", "<S>"), ("aa", "b", "c"), ("<P", "<PS", "<M"), ("", "b", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fim.transformed(docs, marks=marks)
    assert fim.restored(fim.transformed(make_docs([]))).collect() == []


# Quality rules

def _expected_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), failed)


def _lines(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    plain = (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", x)).strip(" ") for x in plain.split("\n"))
    return {x for x in plain if x}


def _expected_kept(rows, line_docs, permille, left):
    """rows of (doc_id, text, host)."""
    texts = {(h or "", t or "") for _, t, h in rows}
    held, sizes = Counter(), Counter()
    for h, t in texts:
        held.update((h, x) for x in _lines(t))
        sizes[h] += bool(_lines(t))
    out = []
    for i, t, h in rows:
        h, t = h or "", t or ""
        total = sum(len(x.split(" ")) for x in _lines(t))
        kept = sum(
            len(x.split(" ")) for x in _lines(t) if not (held[h, x] > line_docs and 1000 * held[h, x] > permille * sizes[h])
        )
        out.append((i, not _expected_rules(t)[-1] and 100 * kept >= left * total))
    return out


def test_rules_agree_with_brute_force(make_docs):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["ab ", "b ", "c\n", "\t", "  ", "#$ ", "é😀 ", "\x0b", "\r\n", "a b c ", "\xa0", "|"])
                     for _ in range(rnd.choice([1, 5, 40, 200, 900]))) for _ in range(150)]
    texts += ["", " \n ", "one", "one two", "a b c", "a b c a b c", "a a a a", "x y x y x y", LONG, None]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "no identifier")]
    got = quality.judged(make_docs(rows)).collect()
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert seen == Counter((i, *_expected_rules(t or "")) for i, t in rows)


def test_runs_that_share_a_hash_are_told_apart(make_docs, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for words in ("ab", "abcdefgh", LONG.split(), [f"w{k}" for k in range(90)])
             for n in (3, 4, 7, 30, 200) for _ in range(5)]
    texts += ["a b c d a b c", "a b c x y z", "a b c x y z a b c x y z", "a bc d ab c d", *ODD]
    for values in (1, 2, 50):  # so few hashes that unequal runs share them, between equal ones too
        monkeypatch.setattr(quality, "run_hash", lambda *words: F.pmod(F.xxhash64(*words), F.lit(values)))
        got = quality.rules(make_docs(list(enumerate(texts)))).collect()
        assert {r.doc_id: r.n_repeat_words for r in got} == {i: _expected_rules(t or "")[4] for i, t in enumerate(texts)}


def test_rules_read_no_text_character_by_character(make_docs, capsys):
    docs = make_docs([(0, "a text")])
    quality.rules(docs).explain("extended")
    assert "translate(" not in capsys.readouterr().out


def test_only_the_letters_a_to_z_are_lower_cased(make_docs):
    texts = ["ABC xyz 12\tI\x0b\x0c\r4 ", "ÀÉ ABC ŁÖ Σας ΟΔΟΣ", "İI \u212a \u212b ẞ ß ǅ", "A\u00a0B\u2003C\x1c", "\U00010400 Z 9\n a  Z 8\nA Z 7"]
    got = make_docs(list(enumerate(texts))).select("doc_id", quality.normalised_lines(F.col("text")).alias("lines")).collect()
    assert {r.doc_id: set(r.lines) for r in got} == {i: _lines(t) for i, t in enumerate(texts)}


def test_depleted_documents_are_rejected(make_docs):
    rnd = random.Random(8)
    common = ["Subscribe to our newsletter, page 12 of 80 ", "Cookies  make this SITE work, accept them all now", "Share | print"]
    own = lambda n: "\n".join(" ".join(rnd.choice("abcdefghij") + str(rnd.random())[2:9].translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(12)) for _ in range(n))
    rows = []
    for i in range(300):
        host = rnd.choice(["big", "big", "big", "small", None, ""])
        lines = [own(rnd.choice([1, 4, 6])), *[c.replace("12", str(i)) for c in common * rnd.choice([0, 1, 4])]]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), host))
    copied = own(5)
    rows += [(i, copied, "big") for i in range(1000, 1060)] + [(7, None, "big"), (None, own(5), "small"), (2000, copied, "small")]
    df = make_docs([]).sparkSession.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.withColumns({c: F.lit("x") for c in ("host", "line", "d1", "total", "n_words", "gone", "kept")}).repartition(5)
    for options in ((10, 10, 50), (3, 200, 80), (0, 0, 100)):
        got = Counter((r.doc_id, r.kept) for r in quality.judged(df, "doc_id", "text", "source", *options).collect())
        assert got == Counter(_expected_kept(rows, *options))
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    assert 0 < len(kept & set(range(300))) < 250 and {*range(1000, 1060), 2000, None} <= kept
    assert quality.judged(make_docs([])).collect() == []


def test_quality_has_no_python_in_its_plan(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    quality.judged(docs).explain("formatted")
    quality.depleted(quality.host_lines(docs)).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|RDD", capsys.readouterr().out)


# Alignment

@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def _tokens(tokenizers, text):
    """(id, begin, end) in bytes of both tokenizers; none where one does not give the text back."""
    a, b = tokenizers
    raw = (" " + text).encode()
    letters = fim_letters()
    of_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or b"".join(t for _, t in of_a) != raw or b"".join(t for _, t in of_b) != raw:
        return [], []
    out = []
    for tokens in (of_a, of_b):
        at, spans = 0, []
        for i, t in tokens:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def fim_letters():
    from sightline.llm.words import _byte_letters

    return {letter: byte for byte, letter in _byte_letters().items()}


def _expected_alignment(tokenizers, rows):
    linked, found = Counter(), []
    for i, text in rows:
        a, b = _tokens(tokenizers, text or "")
        links = Counter((x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e)
        linked.update(links.keys())
        cuts = [0, *sorted({e for _, _, e in a} & {e for _, _, e in b})]
        groups = ["|".join(",".join(str(x) for x, s, _ in side if lo <= s < hi) for side in (a, b)) for lo, hi in zip(cuts, cuts[1:])]
        found.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    return Counter(
        (i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if linked[p] == most[p[0]]),
         sum(n * linked[p] for p, n in links.items()), ";".join(groups))
        for i, n_a, n_b, groups, links in found
    )


def test_alignment_agrees_with_brute_force(make_docs, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "PORTION", 300)  # several portions in a task
    rnd = random.Random(9)
    pieces = ["the ", "and", "Überraschung ", "été ", "\n", "  ", "😀", "한", "<|endoftext|>", "<s>", "<0x41>", "▁", "don't ", "123", "\x00", "zzzz", "\t"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 4, 30]))) for _ in range(120)]
    texts += [None, "", " ", "a", "▁", "ﬁ", "the end", "the end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 400]
    rows = list(enumerate(texts)) + [(None, "no identifier"), (0, texts[0]), (0, texts[0])]
    got = alignment.aligned(make_docs(rows), with_groups=True).collect()
    seen = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got)
    assert seen == _expected_alignment(tokenizers, rows)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got)
    assert any(r.n_a == 0 and r.doc_id is not None for r in got) and alignment.aligned(make_docs([])).collect() == []


def test_alignment_of_a_very_long_text(make_docs, tokenizers):
    text = "aé" * 3000 + LONG[:60_000]
    got = alignment.aligned(make_docs([(1, text), (2, "the line")]), with_groups=True).collect()
    a, b = _tokens(tokenizers, text)
    row = next(r for r in got if r.doc_id == 1)
    assert (row.n_a, row.n_b) == (len(a), len(b))
    assert row.n_groups == len({e for *_, e in a} & {e for *_, e in b})
    assert row.n_links == len(a) + len(b) - row.n_groups  # gapless rows cross one border at a time


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 39)), st.sets(st.integers(1, 39)))
def test_groups_and_links_of_any_borders(x, y):
    a, b = (np.array([0, *sorted(s), 40]) for s in (x, y))
    group = alignment.coalesced(np.append(a[:-1], b[:-1]), np.append(a[1:], b[1:]))
    common = sorted(set(a[1:]) & set(b[1:]))
    expected = [int(np.searchsorted(common, e)) for e in (*a[1:], *b[1:])]
    assert group.tolist() == expected
    i, j = alignment.overlapping(a, b)
    pairs = [(p, q) for p in range(len(a) - 1) for q in range(len(b) - 1) if a[p] < b[q + 1] and b[q] < a[p + 1]]
    assert list(zip(i.tolist(), j.tolist())) == pairs


def test_packed_links_come_back():
    rnd = np.random.default_rng(4)
    place = np.unique(rnd.integers(0, 1 << 31, 500))
    times = rnd.integers(1, 1 << 20, len(place))
    for p, t in ((place, times), (place[:0], times[:0])):
        back = alignment.unpacked(alignment.packed(p, t))
        assert back[0].tolist() == p.tolist() and back[1].tolist() == t.tolist()


def test_aligning_a_portion_holds_a_stretch_of_it(monkeypatch):
    aligner = alignment.Aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "line", "été", "😀", "don't", "zzzz"]) for _ in range(400)) for _ in range(600)]
    aligner.align(texts[:1])
    tracemalloc.start()
    rows, pairs, documents = aligner.align(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, texts))  # 26 bytes a character; tokens and links of the whole portion took 94
    for stretch in (1, 1 << 30):
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        again = aligner.align(texts)
        assert again[0] == rows and again[1].tolist() == pairs.tolist() and again[2].tolist() == documents.tolist()

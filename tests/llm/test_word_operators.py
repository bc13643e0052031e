"""Packing, spelling variants and word runs against brute force, and on nulls, odd texts, ties and empty tables."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm.packing import bin_patterns, fullest, packed, parts, sequences, token_pieces
from stockloom.llm.queries import QUERIES
from stockloom.llm.runs import find_runs, looped, word_runs
from stockloom.llm.spelling import decomposed, gram_dictionary, lookups, spelling_groups, word_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, piece string, start string, word string, n string, runs string, _rank string"
ODD = [
    "", None, " ", "  ", "\n \t  x", "one", "one  two  three \n four\n", " lead", "trail ", "a  b   c", "it's  we'll don't", "漢字 🙂   wide",
    "x " * 4000, "A" * 9000, "é é É", "tab\t tab", "same words here", "same words here", "<|endoftext|> and on", "1 22  333 4,4.4",
]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "p", "s", "w", "n", "r", "k") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blank, long and repeated texts, a repeated and a null id, clashing extra columns."""
    return docs_of(spark, [*ODD, "no id no id", "no id no id", "again", "again"], [*range(len(ODD)), None, None, 3, 3])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11 packing --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_parts_have_the_ids_of_the_text(tokenizer):
    r = random.Random(3)
    signs = [" ", " ", " ", "\n", "\t", "a", "bc", "Ä", "'s", "7", "!", "漢", " ", " ", "\x1c", "\x85", "<|endoftext|>"]
    texts = [*(t for t in ODD if t), *("".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(3000))]
    for text in texts:
        cut = parts(text)
        assert "".join(cut) == text
        assert [i for p in cut for i in tokenizer.encode(p, add_special_tokens=False).ids] == ids_of(tokenizer, text)[:-1], repr(text)


def check_packing(rows, expected, length):
    """``rows(doc_id, piece, start, length, ids, sequence_id, offset)`` against the ids of every document."""
    got = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.length == len(r.ids) // 4
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    whole = collections.defaultdict(list)
    for i, ids in expected:
        whole[i].append(ids)
    assert set(got) == set(whole)
    for i, texts in whole.items():
        if len(texts) == 1:
            at = 0
            for n, (piece, start, ids) in enumerate(sorted(got[i])):
                assert (piece, start) == (n, at) and (n == 0 or len(ids) == length)
                at += len(ids)
            assert [x for p in sorted(got[i]) for x in p[2]] == texts[0]
        assert sum(len(p[2]) for p in got[i]) == sum(map(len, texts))
    return len(bins)


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_packing_of_odd_documents(spark, odd, empty, tokenizer, length):
    cut = token_pieces(odd, TOKENIZER, length)
    rows = packed(cut, length).collect()
    expected = [(r.doc_id, ids_of(tokenizer, r.text)) for r in odd.collect()]
    n = check_packing(rows, expected, length)
    assert n >= -(-sum(len(x) for _, x in expected) // length)
    assert sorted(map(str, packed(cut, length).collect())) == sorted(map(str, rows))  # repeatable
    whole = sequences(packed(cut, length)).collect()
    assert len(whole) == n and all(len(r.ids) == 4 * r.n_tokens <= 4 * length for r in whole)
    assert packed(token_pieces(empty, TOKENIZER, length), length).collect() == []


def test_the_query_packs_every_document(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op11_packing"](spark, SF).collect()
    ids = {r.doc_id: ids_of(tokenizer, r.text) for r in docs}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    used = {r.sequence_id for r in rows}
    assert len(used) <= -(-sum(map(len, ids.values())) // 2048) * 1.01 + 1


def best_fill(sizes, room):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= room}
    return max(sums)


def test_every_bin_is_filled_as_well_as_can_be():
    r = random.Random(8)
    for _ in range(200):
        room = r.randint(1, 40)
        sizes = [r.randint(1, room) for _ in range(r.randint(1, 25))]
        counts = collections.Counter(sizes)
        got = fullest(counts, room)
        assert all(n <= counts[s] for s, n in got.items())
        assert sum(s * n for s, n in got.items()) == best_fill(sizes, room)
        patterns = bin_patterns(counts, room)
        assert sum((collections.Counter({s: n * times for s, n in p.items()}) for p, times in patterns), collections.Counter()) == counts


def optimum(sizes, room):
    """Fewest bins, by trying every place of each piece."""
    best = len(sizes)

    def put(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= rest[0]:
                left = list(bins)
                left.remove(b)
                put(rest[1:], [*left, b - rest[0]])
        put(rest[1:], [*bins, room - rest[0]])

    put(sorted(sizes, reverse=True), [])
    return best


def test_few_bins_are_used_beyond_the_optimum():
    r, more = random.Random(2), 0
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        used, least = sum(times for _, times in bin_patterns(collections.Counter(sizes), 20)), optimum(sizes, 20)
        assert least <= used <= least + 1
        more += used - least
    assert more <= 3


def test_patterns_stay_few_however_many_pieces_there_are():
    r = random.Random(4)
    counts = {s: r.randint(1, 10**9) for s in range(1, 2049)}
    patterns = bin_patterns(counts, 2048)
    assert len(patterns) < 6000
    assert sum(t for _, t in patterns) <= sum(s * n for s, n in counts.items()) // 2048 * 1.01 + 2


# ---- 12 spelling variants ----------------------------------------------------------------------


def brute_words(rows, every, points=5, least=3):
    total = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= points and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n_of, times=2):
    near = {w: [v for v in n_of if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n_of}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n_of[v], v), default=None)
        form[w] = best if best is not None and n_of[best] >= times * n_of[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), n_of.get(form[w])) for w, n in n_of.items()}


def grouped(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("longest", "most"), [(8, 200_000), (3, 10), (2, 0), (12, 50)])
def test_groups_are_those_of_brute_force(spark, longest, most):
    """Few letters and syllables make many neighbours; no dictionary changes what is found."""
    r = random.Random(longest)
    words = {"".join(r.choice(["a", "b", "ab", "ca", "é"]) for _ in range(r.randint(3, 9))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab"}
    n_of = {w: r.choice([3, 4, 6, 9, 20, 50]) for w in words if len(w) >= 5}
    df = spark.createDataFrame(sorted(n_of.items()), "word string, n long")
    got = spelling_groups(df, longest=longest, most=most)
    assert got.count() == len(n_of) and grouped(got) == brute_groups(n_of)


def test_unaffected_grams_meet_for_every_edit():
    """Whatever the edit, both words look up one list in common."""
    r = random.Random(1)
    frequent = {"".join(r.choice("ab") for _ in range(q)): 9 for q in (2, 3, 4) for _ in range(6)} | {"^a": 40, "ab$": 7}
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(5, 12)))
        i = r.randrange(len(w))
        gone, put = lookups(w, frequent, 5)
        assert gone & lookups(w[:i] + r.choice("abc") + w[i + 1 :], frequent, 5)[0]
        assert lookups(w[:i] + w[i + 1 :], frequent, 5)[1] & gone
        assert lookups(w + "c", frequent, 5)[0] & put
        for _, letters, a, b in decomposed(f"^{w}$", frequent, 5):
            assert f"^{w}$"[a:b] == letters and 2 <= b - a <= 5


def test_the_query_groups_all_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_spelling"](spark, SF)
    assert grouped(got) == brute_groups(brute_words(docs, 97))


def test_spelling_of_odd_documents(spark, odd, empty):
    texts = ["Straße STRASSE straßen ÀÉÎ× ÷ÿ abcde", "abcde ABCDE abcdé abcde", "abcdef abcdef abcdef abxdef abxdef abxdef " * 5, None, ""]
    docs = docs_of(spark, [*texts, *texts], [*range(5), None, 3, 3, 3, 3]).unionByName(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for every in (None, 2):
        words = word_counts(docs, slip_every=every)
        assert {(r.word, r.n) for r in words.collect()} == set(brute_words(rows, every).items())
        assert grouped(spelling_groups(words)) == brute_groups(brute_words(rows, every))
    assert spelling_groups(word_counts(empty)).collect() == []
    assert gram_dictionary(word_counts(empty)) == {}
    with pytest.raises(ValueError, match="times"):
        spelling_groups(words, times=1)


# ---- 13 periodic runs --------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, every):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if every and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // every
        if h % every == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    rest = b" ".join(x for i, x in enumerate(w) if i not in drop)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_runs_are_those_of_brute_force():
    r = random.Random(6)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            w = []
            while len(w) < r.randint(0, 60):
                unit = [r.randint(0, 2) for _ in range(r.randint(1, 5))]
                w += (unit * r.randint(1, 9))[: r.randint(1, 40)]
            texts.append(w)
        first = np.concatenate(([0], np.cumsum([len(w) for w in texts])))
        ids = np.array([x for w in texts for x in w], np.int64)
        assert find_runs(ids, first) == [brute_runs(w) for w in texts]
        assert find_runs(ids, first, least=2, times=2) == [brute_runs(w, 2, 2) for w in texts]


def test_word_runs_of_odd_documents(spark, odd, empty):
    r = random.Random(9)
    texts = ["la " * 50 + "end", "a b " * 6 + "a c " * 6, "x y z " * 4, "x y z x y z x y z", " ".join("ab"[r.random() < 0.3] for _ in range(400)), "Ä ä " * 9]
    docs = docs_of(spark, texts).unionByName(odd)
    for every in (None, 1, 3):
        got = word_runs(docs, loop_every=every)
        assert got.columns == ["doc_id", "runs", "collapsed"]
        kept = sorted((str(r.doc_id), [tuple(x) for x in r.runs], hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in got.collect())
        expected = []
        for row in docs.collect():
            w = (row.text or "").encode().split()
            source = looped(len(w), row.doc_id, every) if every else None
            w = w if source is None else [w[i] for i in source]
            expected.append((str(row.doc_id), brute_runs(w) if len(w) < 1000 else None, brute_row(row.doc_id, row.text, every)[-1] if len(w) < 1000 else None))
        assert len(kept) == len(expected)
        long = [k for k, e in zip(kept, sorted(expected, key=str)) if e[1] is None]
        assert sorted(k for k in kept if len(str(k)) and k not in long) and all(e in kept for e in expected if e[1] is not None)
    assert word_runs(empty, loop_every=10).collect() == []


def test_the_query_finds_all_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 12000 or text is null").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_word_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r[1] > 0 for r in got.values()) > 5
    for r in docs:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text, 10)


def test_a_long_run_takes_no_square_of_its_length(spark):
    docs = docs_of(spark, ["x " * 200_000, "a b c " * 50_000])
    rows = {r.doc_id: r for r in word_runs(docs).select("doc_id", "runs", F.length("collapsed").alias("n")).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(0, 200_000, 1)] and rows[0].n == 1
    assert [tuple(x) for x in rows[1].runs] == [(0, 150_000, 3)] and rows[1].n == 5

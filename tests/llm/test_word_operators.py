"""Spelling variants, repeated passages and periodic runs: the registered queries against plain Python on odd rows, and corner cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import oracles, periods, queries, repeats, variants, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, runs int, _doc string, _SALT int, n_words string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_texts(seed, n=140):
    """Prose of few words with shared passages, near copies, loops, odd white space, and rows of every odd kind."""
    rng = random.Random(seed)
    vocabulary = ["Straße", "naïve", "letter", "letters", "Better", "better", "bitter", "日本語", "a", "b", "c", "x\x85y", "É", "ÉCOLES", "école", "lettre"] + [f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([49, 50, 51, 70, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 4)):
            kind = rng.random()
            if kind < 0.5:
                more = list(rng.choice(passages))
                if rng.random() < 0.3:
                    more[rng.randrange(len(more))] = "changed"
            elif kind < 0.8:
                unit = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]
                more = unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit))]
            else:
                more = [rng.choice("ab") for _ in range(rng.randrange(40))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = more
        rows.append((rng.randrange(3 * n), rng.choice([" ", "  ", "\n", "\x0b\t"]).join(text)))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (5, None), (6, ""), (7, " \n\x0c"), (None, None), rows[3], rows[3], (0, rows[3][1]), (1, "w " * 3_000), (2, "w " * 2_999), (8, "x" * 3_000), (-4, rows[9][1])]
    return [(d, t, "en", 1, "d", 2, "n") for d, t in rows]


@pytest.fixture(scope="module", params=[1, 2])
def folder(spark, request, tmp_path_factory):
    rows = some_texts(request.param)
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path), [r[:2] for r in rows]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def result(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_variants", "op12_repeats", "op13_periods"])
def test_no_rows_give_no_rows(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op12_repeats", "op13_periods"])
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.queries()[name](spark, SF)
    want = con.execute(oracles.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert result(got.select(*columns)) == Counter(want.fetchall())


# Words


def test_word_hashes_tell_words_apart_whatever_the_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    words.powers.cache_clear()
    rng, known = random.Random(3), {}
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "b", "é", "  ", "\n", "\x85", "x" * rng.randrange(1, 90), "日"]) for _ in range(rng.randrange(0, 60))) for _ in range(5)] + [None]
        for at, data, offsets in words.pieces(pa.array(texts), most=rng.choice([64, 200])):
            h, first, stop, bounds = words.hashed_words(data, offsets)
            for i in range(len(offsets) - 1):
                own = [data[first[j] : stop[j]].tobytes() for j in range(bounds[i], bounds[i + 1])]
                assert own == (texts[at + i] or "").encode().split()
                assert all(known.setdefault(w, x) == x for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    monkeypatch.undo()
    words.powers.cache_clear()


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counted, ratio=5):
    out = {}
    for w, n in counted.items():
        near = [v for v in counted if one_edit(w, v)]
        best = min(near, key=lambda v: (-counted[v], v), default=None)
        out[w] = (best if best is not None and counted[best] >= ratio * n else None, n, len(near))
    rows = Counter()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w, form, root, n, n_near, counted[form] if form is not None else None] += 1
    return rows


def test_variants_against_plain_words(spark, folder):
    path, rows = folder
    counted = Counter()
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    kept = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}
    got = queries.op11_variants(spark, path).select("word", "form", "root", "n", "n_near", "form_n")
    assert result(got) == plain_groups(kept) and len(kept) > 30


@pytest.mark.parametrize("block", [1, 64])
def test_blocks_are_subdivided_and_no_pair_is_lost_or_told_twice(spark, block):
    rng = random.Random(block)
    made = set()
    for stem in ("unbelievable", "ab", "äöüäöü", "nationation"):
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "n", "é", "x"])
            made.add("".join(w))
    made = made - {""} | {"a", "b", "z" * 200, "z" * 201, "z" * 199 + "y"}
    counted = {w: rng.choice([1, 2, 5, 10, 10, 50, 300, 2_000]) for w in made}
    df = spark.createDataFrame(list(counted.items()), "word string, n bigint")
    pairs = [(r.word, r.other, r.n) for r in variants.near(df, block).collect()]
    want = {(a, b, counted[b]) for a in made for b in made if a != b and one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    got = variants.group(df, 5, block).select("word", "form", "root", "n", "n_near", "form_n")
    assert result(got) == plain_groups(counted)


def test_a_pair_is_told_once_where_a_small_and_a_large_block_lead_to_the_same_characters(spark):
    # four first letters are shared by few words; three and the last one by many, which lead to four and one as well
    counted = {f"abc{x}{y}z": 5 + i for i, x in enumerate("abcdefghijklmnopqrstuvwx") for y in "abc"}
    df = spark.createDataFrame(list(counted.items()), "word string, n bigint")
    pairs = [(r.word, r.other) for r in variants.near(df, 8).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counted for b in counted if a != b and one_edit(a, b)}


# Repeated passages


def plain_removal(rows, window=50):
    first = defaultdict(lambda: float("inf"))
    for doc, text in rows:
        own = split(text)
        if doc is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i : i + window])
                first[key] = min(first[key], doc)
    out = []
    for doc, text in rows:
        own = split(text)
        gone = set()
        if doc is not None:
            for i in range(len(own) - window + 1):
                if first[tuple(own[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        out.append((doc, len(own), sorted(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def test_repeats_against_plain_windows(spark, folder):
    path, rows = folder
    want = Counter((doc, n, len(gone), sha(kept)) for doc, n, gone, kept in plain_removal(rows))
    got = queries.op12_repeats(spark, path).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert result(got) == want and sum(n for _, _, n, _ in want) > 1_000


def test_repeats_in_other_windows_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 40)  # very long texts are worked on so
    rows = [r[:2] for r in some_texts(7, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnsRenamed({"text": "Body"}).withColumns({"_contexts": F.lit(1), "doc": F.lit("d"), "anchor": F.lit(0)})
    for window, gram in ((12, 5), (2, 1)):
        got = repeats.remove(df, text="Body", window=window, gram=gram)
        assert got.columns == [*df.columns, "n_words", "removed", "kept"]
        found = Counter((r.doc_id, r.n_words, tuple(i for s in r.removed for i in range(s.start, s.stop)), r.kept) for r in got.collect())
        assert found == Counter((doc, n, tuple(gone), kept) for doc, n, gone, kept in plain_removal(rows, window))


def test_stretches_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"a b {shared} c"), (2, f"{shared} d {shared}"), (3, f"e {shared[:-4]}")]
    got = {r.doc_id: ([tuple(s) for s in r.removed], r.kept) for r in repeats.remove(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ([], rows[0][1]), 2: ([(0, 60), (61, 121)], "d"), 3: ([(1, 60)], "e")}


def test_a_clash_of_names_is_told(spark):
    with pytest.raises(ValueError, match="kept"):
        repeats.remove(spark.createDataFrame([(1, "a", 2)], "doc_id int, text string, KEPT int"))
    with pytest.raises(ValueError, match="runs"):
        periods.find(spark.createDataFrame([("a", 2)], "text string, Runs int"))


# Periodic runs


def plain_runs(own, least=12):
    found, n = {}, len(own)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if own[i] != own[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and own[j] == own[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)  # the smallest period comes first
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc, text):
    own = split(text)
    if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and own:
        n, g = len(own), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(own)
    s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for start, long, q in runs for i in range(start + q, start + long)}
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc, len(runs), s, length, p, 1000 * length // p if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(own) if i not in gone))


def test_periods_against_plain_search(spark, folder):
    path, rows = folder
    want = Counter(plain_row(*r) for r in rows)
    assert result(queries.op13_periods(spark, path)) == want
    assert sum(r[1] for r in want) > 50


def test_grid_on_words_of_few_letters(monkeypatch):
    rng = random.Random(11)
    for pairs in (1, 50, 1 << 19):
        monkeypatch.setattr(periods, "PAIRS", pairs)
        texts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 70))] for _ in range(150)]
        # Thue-Morse words, which defeat polynomial hashes modulo powers of two, and Fibonacci words, of most runs
        texts.append([bin(i).count("1") & 1 for i in range(1_500)])
        a, b = [0], [0, 1]
        while len(b) < 600:
            a, b = b, b + a
        texts.append(b)
        bounds = np.cumsum([0, *map(len, texts)])
        ids = np.array([x for t in texts for x in t], np.uint64)
        for least in (12, 2):
            every = periods.grid_runs(ids, bounds, least)
            edges = np.searchsorted(every[:, 0], bounds)
            for i, text in enumerate(texts):
                got = every[edges[i] : edges[i + 1]] - [bounds[i], bounds[i], 0]
                assert sorted((s, e - s, p) for s, e, p in got.tolist()) == plain_runs(text, least)


def test_a_lying_hash_is_found_out():
    own = [b"a", b"b"] * 9 + [b"c"]
    assert periods.verified(own, np.array([[0, 19, 2]])).tolist() == [[0, 18, 2]]
    assert periods.verified(own, np.array([[0, 17, 2]])).tolist() == [[0, 18, 2]]

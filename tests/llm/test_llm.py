from __future__ import annotations

import base64
import functools
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from shutterlake.llm import canonical, clusters, encoding, mixing, neighbours, tokens, vectors
from shutterlake.llm.codepages import decoded
from shutterlake.llm.features import FeatureTree, ward

HAS_VOCABULARY = Path(tokens.VOCABULARY).exists()


# Clusters and neighbours
def people(seed: int, n: int, groups: int, spread: float) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, 64))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = c[r.integers(0, groups, n)] + r.normal(size=(n, 64)) * spread * r.random((n, 1))
    return x * r.uniform(0.2, 30, (n, 1))


def table(spark, x: np.ndarray, extra: list | None = None):  # noqa: ANN001, ANN201
    rows = [(i + 1, [float(v) for v in r], 0) for i, r in enumerate(x)] + (extra or [])
    return spark.createDataFrame(rows, "face_id long, embedding array<float>, id long")


def truth(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity to 6 decimals, smallest row of each row's group)."""
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    lab = np.arange(len(x))
    while True:
        new = np.where(s >= 0.9, lab[None], len(x)).min(1)
        if (new == lab).all():
            return s, lab
        lab = new


UNUSABLE = [(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [1.0] * 63, 0), (9004, [float("nan")] * 64, 0), (9005, [float("inf")] + [1.0] * 63, 0), (9006, [None] + [1.0] * 63, 0), (None, [1.0] * 64, 0)]


def test_clusters_equal_brute_force(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(vectors, "CHUNK", 64)
    x = people(1, 500, 60, 0.09)
    _, lab = truth(x)
    size = Counter(lab.tolist())
    want = {(lab[i] + 1, i + 1) for i in range(len(x)) if size[lab[i]] > 1}
    again = [(i + 1, [float(v) for v in x[i]], 7) for i in range(0, 500, 50)]
    got = [tuple(r) for r in clusters.clustered(table(spark, x, UNUSABLE + again), "face_id", "embedding").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize(("dims", "cells"), [(4, 6), (10, 8), (64, 40)])
def test_no_link_is_lost_whatever_the_data(spark, monkeypatch, dims: int, cells: int) -> None:  # noqa: ANN001
    """Vectors spread evenly over few or many dimensions, in blocks of a few rows: pairs at the edges of cells are found all the same."""
    monkeypatch.setattr(vectors, "CELLS", cells)
    monkeypatch.setattr(vectors, "CHUNK", 32)
    monkeypatch.setattr(vectors, "meetings", functools.partial(vectors.meetings, block=25))
    r = np.random.default_rng(dims)
    x = np.zeros((600, 64))
    x[:, :dims] = r.standard_normal((600, dims))
    x[300:] = x[:300] + r.standard_normal((300, 64)) * 0.055 * np.linalg.norm(x[:300], axis=1)[:, None]
    _, lab = truth(x)
    size = Counter(lab.tolist())
    got = {(r.cluster_key, r.id) for r in clusters.clustered(table(spark, x), "face_id", "embedding").collect()}
    assert got == {(lab[i] + 1, i + 1) for i in range(len(x)) if size[lab[i]] > 1}


def test_blocks_of_leaves_are_not_copied_for_each_pair(spark, monkeypatch) -> None:  # noqa: ANN001
    """Strays in 24 blocks: the rows that meet are written once, not once for each pair of blocks, and no link is lost."""
    monkeypatch.setattr(vectors, "CELLS", 8)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    x = np.random.default_rng(3).standard_normal((600, 64))
    x[300:] = x[:300] + np.random.default_rng(4).standard_normal((300, 64)) * 0.4
    _, lab = truth(x)
    size = Counter(lab.tolist())
    made, seen = vectors.in_blocks, []
    monkeypatch.setattr(vectors, "in_blocks", lambda df, by, *a: seen.append(df.count()) or made(df, by, *a))
    got = {(r.cluster_key, r.id) for r in clusters.clustered(table(spark, x), "face_id", "embedding").collect()}
    assert got == {(lab[i] + 1, i + 1) for i in range(len(x)) if size[lab[i]] > 1}
    assert len(seen) == 1 and 300 < seen[0] <= 600 * 9


def test_profiles(spark) -> None:  # noqa: ANN001
    x = people(6, 120, 10, 0.05)
    _, lab = truth(x)
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {}
    for g in set(lab.tolist()):
        r = np.flatnonzero(lab == g)
        if len(r) > 1:
            c = u[r].sum(0)
            sim = np.round(u[r] @ c / np.linalg.norm(c), 6)
            want[g + 1] = (len(r), [int(r[k]) + 1 for k in sorted(range(len(r)), key=lambda k: (-sim[k], r[k]))[:3]])
    got: dict = {}
    for r in sorted(clusters.profiles(table(spark, x, UNUSABLE), "face_id", "embedding").collect(), key=lambda r: r.rank):
        got.setdefault(r.cluster_key, (r.size, []))[1].append(r.id)
    assert got == want


def test_a_hot_cluster_and_a_chain(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(vectors, "CHUNK", 50)
    monkeypatch.setattr(vectors, "TASK_ROWS", 40)
    hot = people(2, 300, 1, 0.01)
    angle = np.arange(30) * 0.4  # neighbours are linked (cos 0.4 = 0.92), others aren't
    chain = np.zeros((30, 64))
    chain[:, 0], chain[:, 1] = np.cos(angle[:8].repeat(4)[:30]), np.sin(angle[:8].repeat(4)[:30])
    x = np.concatenate([hot, chain])
    _, lab = truth(x)
    got = {(r.cluster_key, r.id) for r in clusters.clustered(table(spark, x), "face_id", "embedding").collect()}
    assert got == {(lab[i] + 1, i + 1) for i in range(len(x))}


def test_no_vectors(spark) -> None:  # noqa: ANN001
    assert clusters.clustered(table(spark, np.zeros((0, 64)), UNUSABLE), "face_id", "embedding").count() == 0
    assert neighbours.most_similar(table(spark, np.zeros((0, 64))), "face_id", "embedding").count() == 0


@pytest.mark.parametrize("block", [8192, 40])
def test_neighbours_against_brute_force(spark, monkeypatch, block: int) -> None:  # noqa: ANN001
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    x = people(3, 400, 12, 0.06)
    x[17] = x[18] * 2  # a tie
    s, _ = truth(x)
    want = set()
    for i in range(len(x)):
        o = sorted((k for k in range(len(x)) if k != i), key=lambda k: (-s[i, k], k))[:5]
        want |= {(min(i, k) + 1, max(i, k) + 1) for k in o if s[i, k] >= 0.9}
    got = [(r.a, r.b) for r in neighbours.pairs(neighbours.most_similar(table(spark, x, UNUSABLE + [(5, [float(v) for v in x[4]], 3)]), "face_id", "embedding")).collect()]
    assert len(got) == len(set(got))
    assert len(want & set(got)) >= 0.99 * len(want)
    assert len(set(got) - want) <= 0.01 * len(want)


def test_estimates_stay_within_their_bounds() -> None:
    x = people(4, 300, 3, 0.05)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = neighbours.Codes(x, x.mean(0), neighbours.rotation())
    est, err = c.bounds(slice(0, 300), slice(0, 300))
    off = ~np.eye(300, dtype=bool)
    assert (np.abs(est - x @ x.T) <= err)[off].mean() > 0.97


def test_feature_trees_merge() -> None:
    x = people(5, 2000, 30, 0.05)
    x /= np.linalg.norm(x, axis=1)[:, None]
    parts = []
    for k in range(4):
        t = FeatureTree(64, 100)
        t.add(np.ones(500), x[k::4])
        parts.append(t)
    whole = FeatureTree(64, 100)
    for t in parts:
        whole.add(t.n, t.sums)
    assert whole.n.sum() == 2000
    assert np.allclose(whole.sums.sum(0), x.sum(0))
    assert len(whole.n) <= 100


def test_ward_joins_the_cheapest_first() -> None:
    p = np.array([[0.0, 0], [0.1, 0], [5, 0], [5.2, 0], [9, 9]])
    g = ward(np.ones(5), p, 3)
    assert g[0] == g[1] != g[2] == g[3] != g[4]
    assert len(set(ward(np.ones(5), p, 9))) == 5


# Canonical values
CATALOG = [(1, "Halvorsen", "Prisma 910"), (2, "Halvorsen", "Prisma 910 Mark II"), (3, "Lumora", "Aster X25"), (4, "Délune", "Monsoon 10 Mark III"), (5, "Xylo Works", "Tall Field 40"), (6, "Other", "Aster X25 Mark II")]


@pytest.mark.parametrize(
    ("make", "model", "want"),
    [
        ("Halvorsen", "Prisma 910", 1), ("HALVORSEN CORP.", "halvorsen corp. prisma-910 mk2", 2), (None, "Ｐｒｉｓｍａ ９１０", 1), ("Prisma 91O MarkII", "Halvörsen", 2), ("Halvosren", "Prizma910", 1),
        ("Lumora\x00", "Аstеr X25", 3), ("Lumora", "Aster X25 Mark II", 0), ("Other", "Aster X25 II", 6), ("Delune", "Monsoon 10 Mark III", 4), ("xylo works", "tallfield 40", 5),
        ("Halvorsen", "Prisma 911", 0), ("Halvorsen", "Prisma 910 Mark III", 0), ("Halvorsen", None, 0), ("Halvorsen", "Aster X25", 0), ("Copyra", "Prisma 910", 0), ("unknown", "none", 0), ("Halvorsen", "Prisma 910 " + "z" * 50_000, 0), ("Halvorsen Imagign", "Prisma 910", 1),
    ],
)
def test_entry_meant(make: str | None, model: str | None, want: int) -> None:
    assert canonical.Catalog(CATALOG).find(make, model) == want


def test_values_are_read_whole() -> None:
    c = canonical.Catalog(CATALOG)
    assert c.find(" " * 4100 + "Halvorsen", " " * 4100 + "Prisma 910") == 1
    assert c.find("Halvorsen " * 70, "Prisma 910") == 1
    assert c.find("Halvorsen " * 70, "Prisma 911") == 0
    for long in ("l" * 300_000, "o" * 300_000 + "a", "word " * 100_000):  # linear time
        assert c.find(long, "Prisma 910") == 0


def test_similar_token_sets() -> None:
    near = [(1, "Nord Optik", "Jasper 620"), (2, "Other", "Aster 621"), (3, "Other", "Aster 50")]
    c = canonical.Catalog(near, [("Brandname", "Nord Optik")])
    assert c.find("Optik Nrod", "Jasper 620") == 1  # in any order, with an edit
    assert c.find("Nord Optik", "Jaster 620") == 1  # a tie of Aster and Jasper, decided by the maker
    assert c.find(None, "Jaster 620") == 0  # and not without
    assert c.find("Brandname", "Jasper 620") == 1  # an alias
    assert c.find("Other to., Ltd.", "Aster 50") == 3  # a misspelt legal form
    assert c.find("Other to", "Aster 50") == 0


def test_mapped_table(spark) -> None:  # noqa: ANN001
    rows = spark.createDataFrame([(1, "Lumora", "Aster X25", 9), (1, "Lumora", "Aster X25", 9), (2, None, None, 9), (3, " \x00", "\t", 9), (4, None, "x", 9)], "key long, make string, model string, catalog_id long")
    cat = spark.createDataFrame(CATALOG, "catalog_id long, make string, model string")
    assert sorted((r.key, r.catalog_id) for r in canonical.mapped(rows, cat).collect()) == [(1, 3), (1, 3), (4, 0)]
    assert {r.catalog_id for r in canonical.mapped(rows, cat.limit(0)).collect()} == {0}
    assert canonical.mapped(rows.limit(0), cat).count() == 0


# Tokens
def tiny() -> dict[bytes, int]:
    r = {bytes([b]): b for b in range(256)}
    for t in (b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa", b" a"):
        r[t] = len(r)
    return r


def test_speculation_is_always_verified() -> None:
    v, r = tokens.Vocabulary(tiny()), random.Random(1)
    words = ["".join(r.choice("abcd é") for _ in range(r.randint(1, 30))) for _ in range(2000)] + ["a" * 5000, "é" * 999]
    ids, bad = v.encode_words(words)
    assert ids == [[v.ranks[p] for p in tokens.merge_exactly(w.encode(), v.ranks)] for w in words]
    assert bad > 0


@pytest.mark.skipif(not HAS_VOCABULARY, reason="no vocabulary")
def test_encoding_equals_the_library(spark) -> None:  # noqa: ANN001
    import tiktoken

    v = tokens.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(2)
    texts = [None, "", "<|endoftext|>", " \n\n  x", "I’d  don't 12345 naïve 写真 🐕‍🦺 \x00﻿", "ab " * 20_000, "Ж" * 9000] + ["".join(chr(r.choice([32, 97, 101, 233, 0x416, 0x5199, 0x1F600, 10])) for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' as ids")
    got = {x.doc_id: x.ids for x in tokens.encoded(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {x.doc_id: x.n_tokens for x in tokens.encoded(df, count_only=True).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert tokens.encoded(df.limit(0)).count() == 0
    assert base64.b64decode(Path(tokens.VOCABULARY).read_bytes().split()[0])


# Mixing
def test_mixture(spark) -> None:  # noqa: ANN001
    r = random.Random(5)
    docs = [(i, r.choice(["a"] * 60 + ["b"] * 10 + ["c"]), r.randint(1, 40), r.random()) for i in range(4000)]
    docs += [docs[0], (9001, None, 5, 1.0), (9002, "a", 0, 1.0), (9003, "other", 5, 1.0), (None, "a", 3, 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 9), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(d, t)
    rows = mix.collect()
    limit = {"a": 2, "b": 4, "c": 9}
    assert len({x.doc_id for x in rows}) == len(rows)
    assert all(1 <= x.copies <= limit[x.source] for x in rows)
    share = {x.source: x for x in mixing.actual_shares(mix, t).collect()}
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert share[s].actual_share == pytest.approx(want, abs=0.01)
    assert share["none"].actual_share == 0
    # The budgets are met as far as whole documents allow, and the cheapest keys come first: bins change nothing
    have = Counter()
    for i, s, n, _ in {x[0]: x for x in docs if x[0] and x[1] in limit}.values():
        have[s] += n
    total = min(have[s] * limit[s] / w for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)))
    for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert total * w - 41 <= share[s].n_tokens <= total * w + 1
    assert mixing.mixture(d.limit(0), t).count() == 0
    assert mixing.mixture(d, t.limit(0)).count() == 0


def test_budget_in_a_crowded_bin(spark) -> None:  # noqa: ANN001
    """Light documents all have large keys: the bin in which the budget ends is cut until few rows are sorted, with the same result."""
    d = spark.range(100_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'b' else 'a' end as source", "id % 50 + 1 as n_tokens", "0.05D as weight")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    few = mixing.mixture(d, t, edge_rows=500)
    assert mixing.mixture(d, t, edge_rows=200_000).exceptAll(few).count() == 0
    sizes: list[int] = []
    real, mixing._end = mixing._end, lambda b, p: (sizes.append(0), real(b, p))[1]
    try:
        mixing.mixture(d, t, edge_rows=500)
    finally:
        mixing._end = real
    assert len(sizes) > 1


def test_heavier_documents_come_sooner(spark) -> None:  # noqa: ANN001
    d = spark.createDataFrame([(i, s, 10, 1.0 if i % 2 else 0.1) for s in ("a",) for i in range(2000)] + [(5000 + i, "b", 10, 1.0) for i in range(100)], "doc_id long, source string, n_tokens long, weight double")
    t = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    odd = Counter(x.doc_id % 2 for x in mixing.mixture(d, t).where("source = 'a'").collect())
    assert odd[1] > 3 * odd[0]


# Garbled text
CLEAN = ["Die Kinder fanden die schöne Mühle früh am Morgen.", "Größere Äpfel hängen über der Straße.", "Il a retrouvé le gâteau près de l’école.", "La niña dibujó el jardín botánico y el faro.", "Мы сняли трёх воздушных змеев в тумане.", "На рассвете дети нашли старую мельницу.", "We met at the café — “twice”, to be safe."]


def garble(s: str, written: str, read: str) -> str:
    return "".join(chr(b) if not bytes([b]).decode(read, "ignore") else bytes([b]).decode(read) for b in s.encode(written))


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp437")])
def test_a_swap_is_undone(written: str, read: str) -> None:
    r = encoding.Restorer(Counter(g for s in CLEAN * 50 for g in encoding.bigrams(s)), {})
    for s in CLEAN:
        try:
            g = garble(s, written, read)
        except UnicodeEncodeError:
            continue
        assert r.text(f"Plain start. {g}", "")[0] == f"Plain start. {s}"
        assert r.text(s, "") == (s, False)


def test_one_byte_and_repeated_swaps() -> None:
    r = encoding.Restorer(Counter(g for s in CLEAN * 50 for g in encoding.bigrams(s)), {})
    assert r.text(CLEAN[5].encode("cp1251").decode("latin-1"), "")[0] == CLEAN[5]
    assert r.text(CLEAN[0].encode("cp437").decode("cp1252", "replace").replace("�", "\x81"), "")[0] == CLEAN[0]
    assert r.text(garble(garble(CLEAN[2], "utf-8", "cp1252"), "utf-8", "cp1252"), "")[0] == CLEAN[2]
    assert r.text("“ÂGE D’OR — ÉTÉ”", "")[1] is False
    assert decoded("Ã©", "cp1252", "utf_8") == "é"


def test_documents(spark) -> None:  # noqa: ANN001
    base = [(i, CLEAN[i % 7], "s") for i in range(700)]
    bad = [(1000, garble(CLEAN[2], "utf-8", "cp1252"), "s"), (1001, "caf�", "s"), (1002, None, "s"), (1003, "", None), (1004, "plain", None), (1000, garble(CLEAN[2], "utf-8", "cp1252"), "s"), (1005, ("x" * 50 + " ") * 5000 + garble(CLEAN[0], "utf-8", "cp1252"), None)]
    d = spark.createDataFrame(base + bad, "doc_id long, text string, source string").selectExpr("*", "1 as restored")
    got = {r.doc_id: r.restored_md5 for r in encoding.repaired(d).collect()}
    assert got == {1000: hashlib.md5(CLEAN[2].encode()).hexdigest(), 1001: "", 1005: hashlib.md5((("x" * 50 + " ") * 5000 + CLEAN[0]).encode()).hexdigest()}
    assert encoding.repaired(d.limit(0)).count() == 0


def test_blocks_of_a_large_group_are_not_copied(spark, monkeypatch) -> None:  # noqa: ANN001
    """p6: a group of several blocks is read from the shared folder, and no row is repeated for the blocks it meets."""
    rng = np.random.default_rng(2)
    x = np.eye(64)[0] + rng.standard_normal((60, 64)) * 0.03
    whole = sorted(map(tuple, neighbours.most_similar(table(spark, x), "face_id", "embedding").collect()))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 9)
    found = neighbours.most_similar(table(spark, x), "face_id", "embedding")
    assert "explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == whole
    assert len(whole) == 300

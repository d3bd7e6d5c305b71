"""Periodic runs, near-duplicate vectors and spelling variants, against brute force and SQL on small tables."""

import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import periodic, permutations, spelling
from llm_fixtures import agrees, duck_docs, frame, rows_of  # noqa: F401


def plain_runs(words):
    """Start, length and smallest period of all runs, by stretches of equal words at every distance."""
    found = {}
    for q in range(len(words) // 4, 0, -1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found[i, j - i + q] = q
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, rewrite):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {k for s_, n_, q_ in runs for k in range(s_ + q_, s_ + n_)}
    rest = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    return doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, sha256(lines.encode()).hexdigest(), sha256(rest).hexdigest()


def periodic_texts():
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3, "a a b " * 5 + "c c " * 9, "é ü " * 8, "x y " * 7]
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 9)):
            unit = list(rng.choice(["a", "b", "cc"], rng.integers(1, 6)))
            parts += unit * int(rng.integers(1, 9))
        texts.append(" ".join(parts))
    return [*texts, " ".join(f"w{k % 700}" for k in range(6000)), "z " * 5000, " ".join(f"u{k}" for k in range(3000))]


@pytest.mark.parametrize("rewrite", [False, True])
def test_periodic_runs_equal_brute_force(frame, rewrite):
    texts = periodic_texts()
    rows = [(k * 7, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (3, "b " * 9), (3, "b " * 9)]
    got = periodic.periodic_runs(frame(rows).repartition(3), rewrite)
    assert rows_of(got) == sorted((plain_row(*r, rewrite) for r in rows), key=repr)


def test_periodic_runs_across_steps(monkeypatch):
    monkeypatch.setattr(periodic, "STEP", 50)
    texts = [(t or "").encode() for t in periodic_texts()[:-3]]
    for text, (_, start, length, period) in zip(texts, periodic.find_runs([None] * len(texts), texts, False), strict=True):
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == plain_runs(text.split())


def test_collapsed_text(frame, spark):
    docs = frame([(1, "go  on on on on on on\nnow"), (2, None)]).withColumn("n_runs", F.lit("kept out")).withColumn("START", F.lit(1))
    got = {r.doc_id: r.collapsed for r in periodic.periodic_runs(docs, texts=True).collect()}
    assert got == {1: "go on now", 2: ""}
    assert periodic.periodic_runs(frame([])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_links(rows):
    """vec_id, n_links, component_id, kept of every row, all pairs compared."""
    n, unit = len(rows), []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float32).astype(float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
               and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def clustered(seed, n, d=16):
    """Vectors around shared centres at distances that straddle the threshold, with copies and scaled copies."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    rows = []
    for k in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(d) * rng.choice([0.0, 0.1, 0.25, 0.4, 2.0])
        rows.append((k, (v * rng.choice([1, 1, 3])).astype(np.float32).tolist(), int(rng.integers(3))))
    return rows


def test_near_vectors_equal_brute_force(spark):
    rows = clustered(1, 300)
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1),
           (905, [None] + [1.0] * 15, 1), (906, rows[0][1], None), (None, rows[0][1], rows[0][2]), (None, [9.0, -1.0], 7),
           (907, [1.0, 0.0], 0), (908, [-0.0, 1.0], 0), (909, [0.0, 1.0], 0), (5, rows[5][1], rows[5][2]), (910, [3e38, 3e38], 0), (911, [1e-38, 1e-38], 0)]
    assert rows_of(permutations.near_vectors(vectors(spark, rows + odd).repartition(4))) == plain_links(rows + odd)
    assert permutations.near_vectors(vectors(spark, [])).count() == 0
    alone = vectors(spark, [(4, [1.0, 2.0], 1)]).withColumn("node", F.lit("x")).withColumn("size", F.lit(9)).withColumn("D", F.lit(9))
    assert rows_of(permutations.near_vectors(alone)) == [(4, 0, 4, True)]


def test_near_vectors_in_split_lists(spark, monkeypatch):
    # A third of the rows are near copies, and every list is longer than a block.
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(24)
    rows = [(k, (centre + rng.standard_normal(24) * 0.12).astype(np.float32).tolist(), 1) for k in range(150)]
    rows += [(k + 150, v, 1) for k, v, _ in clustered(6, 250, 24)]
    monkeypatch.setattr(permutations, "BLOCK", 16)
    monkeypatch.setattr(permutations, "STEP", 500)
    got = rows_of(permutations.near_vectors(vectors(spark, rows)))
    want = plain_links(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_near_vectors_recall_at_the_threshold(spark):
    # Pairs of cosine 0.93 to 0.95 only, among many others: the hardest to retrieve.
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        c = rng.uniform(0.9305, 0.95)
        rows += [(2 * k, x.astype(np.float32).tolist(), 0), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).astype(np.float32).tolist(), 0)]
    got = permutations.near_vectors(vectors(spark, rows)).filter("n_links > 0").count()
    assert got >= 0.98 * len(rows)


def plain_spelling(rows, deletions):
    counts = {}
    for doc_id, text in rows:
        for run in spelling.LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if deletions and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    around = {w: sorted((x for x in words if x != w and near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] if x and words[x[0]] >= 2 * words[w] else None for w, x in around.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def spelling_rows():
    rng = np.random.default_rng(2)
    rows = [(None, "color colour Colour"), (1, None), (2, ""), (3, "ÉTÉÉÉ étééé x" * 2), (4, "a" * 5000 + " " + "a" * 4999)] * 3
    words = ["".join(rng.choice(list("aeé"), rng.integers(4, 9))) for _ in range(60)]
    for k in range(150):
        rows.append((k, " 1-".join(rng.choice(words, 12, p=np.arange(1, 61) / 1830))))
    return rows


@pytest.mark.parametrize("deletions", [False, True])
def test_spelling_variants_equal_brute_force(frame, deletions):
    rows = spelling_rows()
    got = spelling.spelling_variants(frame(rows).repartition(4), deletions).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows_of(got) == plain_spelling(rows, deletions)


def test_spelling_variants_delete_once(frame, agrees):
    # Both runs lose a letter, and the longer one turns into the shorter.
    rows = [(1, "tgktbyg tgktbg " * 3 + "other " * 7), (2, "tgktbyg")]
    got = spelling.spelling_variants(frame(rows), deletions=True).select("word", "form", "root", "n", "n_near", "form_n")
    assert [r[0] for r in rows_of(got)] == ["other", "tgktbg", "tgtbg"]
    assert rows_of(got) == plain_spelling(rows, True)
    agrees(lambda d: spelling.spelling_variants(d, deletions=True), rows, spelling.SQL)


def test_spelling_variants_in_blocks(frame, monkeypatch):
    for name in ("BLOCK", "TOGETHER", "HELD"):
        monkeypatch.setattr(spelling, name, 7)
    rows = spelling_rows()
    got = spelling.spelling_variants(frame(rows)).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows_of(got) == plain_spelling(rows, False)


def test_spelling_variants_of_odd_tables(frame, agrees):
    assert spelling.spelling_variants(frame([])).count() == 0
    assert spelling.spelling_variants(frame([(1, "abc def")])).count() == 0
    docs = frame([(1, "hello hello hello")]).withColumn("word", F.lit("x")).withColumn("N", F.lit(1)).withColumn("root", F.lit(1))
    assert rows_of(spelling.spelling_variants(docs)) == [("hello", None, "hello", 3, 0, None)]
    agrees(lambda d: spelling.spelling_variants(d, deletions=True), [r for r in spelling_rows() if r[0] is not None], spelling.SQL)


def test_near_vectors_equal_sql(spark):
    rows = clustered(9, 120)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [*rows, (200, None, 1), (201, [0.0] * 16, 2)])
    want = con.execute(permutations.SQL).fetchall()
    assert rows_of(permutations.near_vectors(vectors(spark, [*rows, (200, None, 1), (201, [0.0] * 16, 2)]))) == sorted(want, key=repr)

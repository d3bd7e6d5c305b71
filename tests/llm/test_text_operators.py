"""Operators with a check in SQL, on texts chosen for their edges."""

import random
import string

import pytest

from estatelens.llm import minhash, mixing, repetition, secret_spans, templates
from llm_fixtures import agrees, duck_docs, frame  # noqa: F401

random.seed(5)
WORDS = ["".join(random.choices(string.ascii_lowercase, k=random.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def secrets():
    r = random.Random(3)
    kinds = [
        lambda: "word", lambda: "é中𝒳", lambda: "password: token=abcdefg", lambda: "token=",
        lambda: 'API_KEY = "sk_' + "".join(r.choices(string.ascii_letters + string.digits, k=30)) + '"',
        lambda: "x" + "".join(r.choices(string.ascii_letters + string.digits + "/+", k=r.randint(10, 60))),
        lambda: "AKIA" + "".join(r.choices(string.ascii_uppercase, k=r.randint(5, 20))),
        lambda: "".join(r.choices("0123456789abcdef", k=r.randint(10, 80))),
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "a" * 30 + "1B",
    ]
    return [(k, " ".join(r.choice(kinds)() for _ in range(25))) for k in range(30)]


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "a b c"), (904, "a b c"), (None, "a b c d e f g"), (906, "é" * 3000)]


def test_secrets(agrees):
    rows = [*secrets(), (900, None), (901, ""), (902, "A1b" + "".join(random.choices(string.ascii_letters + string.digits, k=3000)))]
    agrees(secret_spans.scan, rows, secret_spans.SQL)


def test_entropy_and_allow_list(frame):
    key = "Zx9Kq2LmP7vR4tYw8BcD1"
    rows = [(1, f"see {key} here"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, f"EXAMPLE{key}"), (4, f"token = {key}")]
    found = {r.doc_id: r.spans for r in secret_spans.scan(frame(rows)).collect()}
    assert found == {1: "entropy:4:25", 2: "", 3: "", 4: "assign:0:29"}


def test_entropy_of_one_case(frame):
    keys = ["9233A8EC41F07D5B6E80", "MZXW6YTBOI2DKNRXG4ZQ", "q7zk2m9xv4tjw8c3hp6n", "CHAPTERONE1CHAPTERON", "aaaabbbb1111aaaabbbb"]
    got = [r.spans for r in secret_spans.scan(frame(list(enumerate(f"see {k} here" for k in keys)))).orderBy("doc_id").collect()]
    assert got == ["entropy:4:24"] * 3 + [""] * 2


def test_allow_list_takes_its_own_stretch_only(frame):
    key, uuid = "Zx9Kq2LmP7vR4tYw8BcD1", "123e4567-e89b-12d3-a456-426614174000"
    texts = [f"example/{key}", f"{key}=example", f"{uuid}_{key}", f"a {key}-EXAMPLE-{key} b", f"{key}EXAMPLE/x", f"{uuid}/{uuid}", f"{key}/{key}"]
    got = [r.spans for r in secret_spans.scan(frame(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["entropy:7:29", "entropy:0:22", "entropy:36:58", "entropy:2:24,entropy:31:53", "", "", "entropy:0:43"]


def test_repetition(agrees):
    line = prose(30, 1)
    rows = [(1, prose(200, 2)), (2, "\n".join([line] * 4)), (3, prose(60, 3) + "\n" + line + "\n\n" + line + "  \n" + line),
            (4, "#a *b $c\n" * 40), (5, "x " * 5000), (6, " ".join([prose(9, 7)] * 3 + [prose(90, 8)])), (900, None), (901, ""),
            (902, " \n\t "), (903, "one"), (904, "\x1c a\x85b   c\n\n"), (906, "é" * 3000)]
    agrees(repetition.repetition, rows, repetition.SQL)


def test_good_documents_keep_rows(spark):
    df = spark.createDataFrame([(1, prose(50, 1), 7, "a"), (2, "short", 8, "b"), (3, None, 9, "c")], "doc_id long, text string, kept int, n_words string")
    got = repetition.good_documents(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, prose(50, 1), 7, "a")]


def test_near_duplicates(agrees):
    base = prose(120, 11).split()
    rows = [(k, prose(80, 100 + k)) for k in range(5, 25)]
    for k in range(30):
        copy = list(base)
        for at in random.Random(k).sample(range(120), k % 9):
            copy[at] = f"new{k}x{at}"
        rows.append((100 + k, " ".join(copy).upper() if k % 2 else " ".join(copy)))
    # A shared passage that is not most of a document, a chain of steps, and exact copies.
    rows += [(200 + k, prose(60, 11) + " " + prose(70, 300 + k)) for k in range(10)]
    rows += [(300 + k, " ".join(base[8 * k:8 * k + 64])) for k in range(7)] + [(400 + k, prose(40, 9)) for k in range(20)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one")]
    agrees(minhash.near_duplicates, rows, minhash.SQL)


def test_near_duplicates_without_ids(frame):
    text = prose(50, 4)
    got = minhash.near_duplicates(frame([(None, text), (7, text), (7, text), (None, "solo words here"), (8, None)])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 46, 7, False), (7, 46, 7, True), (7, 46, 7, True), (None, 1, None, True), (8, 0, 8, True)], key=repr)


def test_line_dedup(agrees):
    rows = [(k, f"{prose(30, k)}\nUser {k} logged in from host{k} with success today again\n{prose(25, 50 + k)}\nAll rights reserved.")
            for k in range(14)]
    rows += [(50 + k, f"{prose(20, 80 + k)}\nyes\nPage {k}") for k in range(9)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "All rights reserved."), (906, "é" * 3000)]
    agrees(lambda d: templates.dedup_lines(d, counts=True), rows, templates.SQL)


def test_line_dedup_of_templates(frame):
    rows = [(k, f"Session {k} was closed by user u{k}\nbody{'abcdefghijkl'[k]} stays here") for k in range(12)]
    got = {r.doc_id: r.text for r in templates.dedup_lines(frame(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"body{'abcdefghijkl'[k]} stays here" for k in range(1, 12))


def test_line_dedup_of_single_tokens(frame):
    lines = ["这是一个在许多文件里重复出现的句子。", "https://example.org/a/long/path?id=12345", "short7"]
    rows = [(k, "\n".join([*lines, f"https://example.org/a/long/path?id={k}"])) for k in range(12)]
    got = {r.doc_id: r.text for r in templates.dedup_lines(frame(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"short7\nhttps://example.org/a/long/path?id={k}" for k in range(1, 12))


def test_line_dedup_of_passages(agrees, frame):
    """A line of 20 words goes from the second document on; one of 19 stays until ten have it."""
    long, short, lone = prose(20, 700), prose(19, 701), "长" * 34
    rows = [(k, f"{prose(9, 710 + k)}\n{long}\n{short}\n{lone}\n{long}") for k in (3, 4)] + [(5, long), (6, f"a {long}"), (7, "长" * 33)]
    agrees(lambda d: templates.dedup_lines(d, counts=True), rows, templates.SQL)
    got = {r.doc_id: r.text for r in templates.dedup_lines(frame([*rows, (3, rows[0][1])])).collect()}
    assert got[3] == rows[0][1] and got[4] == f"{prose(9, 714)}\n{short}" and got[5] == "" and got[6] == f"a {long}"


def test_line_dedup_of_lone_tokens_equals_sql(agrees):
    rows = [(k, f"https://example.org/a/long/path?id=12345\nshort7\nhttps://example.org/a/long/path?id={k}\nsee id {k}") for k in range(12)]
    agrees(lambda d: templates.dedup_lines(d, counts=True), rows, templates.SQL)


def test_line_dedup_without_ids(frame):
    """Rows without doc_id are documents by their text; one with an id keeps the line, else exactly one of them."""
    long = prose(25, 720)
    texts = [f"{prose(8, 730 + k)}\n{long}" for k in range(5)]
    got = [r.text for r in templates.dedup_lines(frame([(None, t) for t in texts] + [(None, texts[0])])).collect()]
    keepers = {t for t in got if long in t}
    assert len(keepers) == 1 and len(got) == 6 and sorted({t.split("\n")[0] for t in got}) == sorted(t.split("\n")[0] for t in texts)
    got = templates.dedup_lines(frame([(None, t) for t in texts] + [(9, texts[4])])).collect()
    assert [r.doc_id for r in got if long in r.text] == [9]
    got = templates.dedup_lines(frame([(None, texts[0]), (None, texts[0]), (None, None), (8, None)])).collect()
    assert sorted((r.text or "") for r in got) == ["", "", texts[0], texts[0]]


def test_line_dedup_odd_columns(spark):
    df = spark.createDataFrame([(None, "a line here", 1), (2, "a line here", 2)] * 12, "doc_id long, text string, lost int")
    got = templates.dedup_lines(df, emptied=False)
    assert got.columns == df.columns and got.count() == 24


def test_mixing(agrees):
    rows = [(k, None, None, f"s{k % 3 if k % 10 else 3}") for k in range(400)] + [(1000, None, None, None), (1001, None, None, "")]
    agrees(mixing.mix, rows, mixing.SQL)


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 0.5, "s2": 3}, {"s0": 0.12345, "s1": 7.5, "s2": 1e6}])
def test_mix_stays_near_its_weights(frame, weights):
    sizes = {"s0": 900, "s1": 300, "s2": 500}
    docs = frame([(k * 10 + int(s[1]), None, None, s) for s, n in sizes.items() for k in range(n)])
    plan = {r.key[1:]: r for r in mixing.plan(docs, weights).collect()}
    period = next(iter(plan.values())).period
    placed = mixing.mix(docs, weights).select("source", "slot", "block", "epoch", "release", "deadline").distinct().collect()
    assert all(r.release <= r.slot < r.deadline for r in placed)
    assert len({r.slot for r in placed}) == len(placed)
    ends = min(max(r.slot for r in placed if r.source == s) for s in sizes)
    for s in sizes:
        have, slots = 0, {r.slot for r in placed if r.source == s}
        for t in range(ends):
            have += t in slots
            assert abs(have - (t + 1) * plan[s].share / period) < 1
    first = mixing.mix(docs, weights).filter("epoch = 0")
    assert first.count() == sum(sizes.values()) == first.select("doc_id").distinct().count()


def test_small_sources_fill_their_slots(frame):
    """A source with a hundredth of the documents and half of the weight fills half of the mix."""
    docs = frame([(k, None, None, "small" if k < 16 else "large") for k in range(1600)])
    placed = mixing.mix(docs, {"small": 1, "large": 1}).select("source", "slot", "block", "epoch").distinct().collect()
    slots = {s: {r.slot for r in placed if r.source == s} for s in ("small", "large")}
    assert len(slots["small"] | slots["large"]) == 1 + max(r.slot for r in placed) and abs(len(slots["small"]) - len(slots["large"])) <= 1


def test_weights_in_whole_ratios_are_exact(frame):
    docs = frame([(k, None, None, f"s{k % 3}") for k in range(300)])
    plan = {r.key: (r.share, r.period) for r in mixing.plan(docs, {"s0": 5, "s1": 0.5}).collect()}
    assert plan == {"=s0": (10, 13), "=s1": (1, 13), "=s2": (2, 13)}


def test_tiny_source_is_repeated_to_the_end(spark, frame):
    """One document with half of the weight: epochs in several short arrays, no slot left empty."""
    docs = frame([(k, None, None, "one" if k == 0 else "rest") for k in range(40_001)])
    placed = mixing.mix(docs, {"one": 1, "rest": 1})
    slots = [r.slot for r in placed.filter("source = 'one'").collect()]
    assert len(slots) == len(set(slots)) == 5000 and placed.count() == 45_000


def test_default_weights_leave_no_slot_empty(frame):
    docs = frame([(k, None, None, "tiny" if k < 8 else "large") for k in range(48_000)])
    placed = mixing.mix(docs).select("source", "slot", "block", "epoch").distinct().collect()
    assert sorted(r.slot for r in placed) == list(range(len(placed))) and max(r.epoch for r in placed) > 3


def test_odd_weights(frame):
    docs = frame([(k, None, None, f"s{k % 2}") for k in range(200)])
    got = mixing.mix(docs, {"s0": 0, "s1": 1}).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 200, 2))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1})
    for weights, message in (({"s0": 0, "s1": 0}, "weight 0"), ({"s2": 1}, "no such sources")):
        with pytest.raises(Exception, match=message):
            mixing.mix(docs, weights).collect()
    assert mixing.mix(frame([]), {"s2": 1}).count() == 0


def test_too_many_sources(frame, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 4)
    with pytest.raises(Exception, match="more than 4 sources"):
        mixing.mix(frame([(k, None, None, f"s{k}") for k in range(5)])).collect()


@pytest.mark.parametrize("operator", [
    secret_spans.scan, repetition.repetition, repetition.good_documents, minhash.near_duplicates, templates.dedup_lines, mixing.mix])
def test_empty_table(frame, operator):
    assert operator(frame([])).count() == 0


@pytest.mark.parametrize("operator", [secret_spans.scan, repetition.repetition, minhash.near_duplicates,
                                      lambda d: templates.dedup_lines(d, counts=True), mixing.mix])
def test_edges_do_not_crash(frame, operator):
    assert operator(frame(EDGES)).count() >= len(EDGES)

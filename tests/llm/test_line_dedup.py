import hashlib
import random

import pytest

from ketframe.llm import line_dedup as op


def textbook(a, b):
    """Patience diff from its description, sharing no code with the operator: quadratic, recursive."""

    def numbered(items):
        return [(x, items[:i].count(x)) for i, x in enumerate(items)]

    def chain(pairs):
        """The longest chain rising in both; of several the one that ends earliest in a, and so on backwards."""
        best = []
        for k, (i, _) in enumerate(pairs):
            best.append(1 + max((best[m] for m in range(k) if pairs[m][0] < i), default=0))
        out, k, need = [], len(pairs), max(best, default=0)
        while need:
            k = min((m for m in range(k) if best[m] == need), key=lambda m: pairs[m][0])
            out.insert(0, pairs[k])
            need -= 1
        return out

    def align(a, b, i, j):
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(i, j), *align(a[1:], b[1:], i + 1, j + 1)]
        if a[-1] == b[-1]:
            return [*align(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
        for x, y in ((a, b), (numbered(a), numbered(b))):
            anchors = chain([(x.index(v), k) for k, v in enumerate(y) if x.count(v) == 1 and y.count(v) == 1])
            if anchors:
                break
        else:
            return []
        out, p, q = [], 0, 0
        for u, v in [*anchors, (len(a), len(b))]:
            out += align(a[p:u], b[q:v], i + p, j + q) + ([(i + u, j + v)] if u < len(a) else [])
            p, q = u + 1, v + 1
        return out

    return align(list(a), list(b), 0, 0)


def deleted(before, lines, least):
    """Lines with characters that one earlier document deletes."""
    pairs = set(textbook(before, lines))
    out = set()
    for i, j in pairs:
        if (i - 1, j - 1) not in pairs:
            run = [j]
            while (i + len(run), j + len(run)) in pairs:
                run.append(j + len(run))
            if sum(len(lines[k]) for k in run) >= least:
                out |= set(run)
    return out


def brute(docs, least):
    """docs: (id, text) rows; the lines to delete of each different row, by alignment with every earlier row."""
    order = lambda d: (d[0] is None, d[0] or 0, hashlib.md5((("-" if d[0] is None else f"i{d[0]}") + "\x1f" + ("-" if d[1] is None else "t" + d[1])).encode()).digest())
    rows = sorted(set(docs), key=order)
    full = {d: [x for x in (d[1] or "").split("\n") if x] for d in rows}
    out = {}
    for n, d in enumerate(rows):
        gone = set()
        for e in rows[:n]:
            if not set(full[e]).isdisjoint(full[d]):
                gone |= deleted(full[e], full[d], least)
        owner, number = [], -1
        for x in (d[1] or "").split("\n"):
            number += x != ""
            owner.append(max(number, 0))
        out[d] = [k for k, o in enumerate(owner) if o in gone]
    return out


def test_patience_is_the_textbooks():
    rng = random.Random(2)
    for _ in range(600):
        a = [rng.randrange(rng.choice([4, 30])) for _ in range(rng.randrange(20))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
            if rng.random() < 0.5:
                del b[rng.randrange(len(b))]
        if rng.random() < 0.3:
            rng.shuffle(b)
        got = op.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
        assert got == textbook(a, b)
    assert op.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_leads_cover_blocks():
    """Every run of enough characters is wholly under leads of its own."""
    import numpy as np

    rng = random.Random(5)
    for least in (1, 7, 20):
        sizes = np.array([rng.choice([1, 2, 9, 30]) for _ in range(25)], np.int32)
        first, end = op.lead_spans(sizes, least)
        for a in range(25):
            for b in range(a + 1, 26):
                inside = [(f, e) for f, e in zip(first, end) if a <= f and e <= b]
                covered = {k for f, e in inside for k in range(f, e)}
                assert covered == (set(range(a, b)) if sizes[a:b].sum() >= least else set())
        hashes = np.arange(25, dtype=np.int64)
        assert len(set(op.lead_hashes(hashes, first, end).tolist())) == len(first)
    assert not len(op.lead_spans(np.zeros(0, np.int32), 5)[0])


def scenes():
    """(documents, removed lines) of cases that share no lines with each other, and so can be judged in one frame."""

    def names(k):
        return [f"{x} of scene {k}" for x in ("first line", "second line", "another one", "the last one")]

    a, b, x, y = names(1)
    twice = f"{a}\n{b}\n{a}\n{b}"  # no line is unique in its document
    yield [twice, twice, f"{twice}\nan own line at its end"], {1: [0, 1, 2, 3], 2: [0, 1, 2, 3]}
    a, b, x, y = names(2)  # the first holder has another order
    yield [f"{b}\nsome own line of scene two\n{a}", f"{a}\n{b}", f"{a}\n{b}"], {1: [1], 2: [0, 1]}
    a, b, x, y = names(3)
    yield [f"{y}\n{x}", f"{x}\n{y}", f"{x}\n{y}", f"{x}\nsome own line between the two\n{y}"], {1: [1], 2: [0, 1], 3: [0, 2]}
    a, b, x, y = names(4)  # so have forty holders, and the last but one has the document's own
    many = [f"{a}\nown line {i} between the two\n{b}" for i in range(40)]
    yield [*many, f"{b}\nown line of the first\n{a}", f"{b}\nown line of the second\n{a}"], {i: [0, 2] for i in range(1, 40)} | {41: [0, 2]}
    verse = "\n\none line\ntwo line\n\nred line\nblu line"  # short and empty lines
    yield [verse, verse, f"own\n{verse}"], {1: [0, 1, 2, 3, 4, 5, 6], 2: [3, 4, 5, 6, 7]}
    yield ["ab\ncd", "ab\ncd", "\n" * 50_000, "\n" * 50_000], {}


def test_scenes(spark):
    docs, want = [], {}
    for k, (texts, gone) in enumerate(scenes()):
        docs += [(100 * k + i, t) for i, t in enumerate(texts)]
        want |= {100 * k + i: gone.get(i, []) for i in range(len(texts))}
    got = {r.doc_id: r.removed for r in op.dedup_lines(spark.createDataFrame(docs, "doc_id int, text string"), removed_col="removed").collect()}
    assert {i: g for i, g in got.items() if i != 340} == {i: w for i, w in want.items() if i != 340}
    assert len(got[340]) == 1  # either line, in the other order


@pytest.mark.parametrize("least", [1, 20])
def test_against_brute_force(spark, least):
    rng = random.Random(least)
    pool = [f"line {i} " + "é" * rng.randrange(12) for i in range(30)] + ["", "", "ab", "long shared licence line of the pool"]
    docs = [(rng.randrange(80) if rng.random() < 0.9 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(90)]
    block = "\n".join(pool[3:12])
    docs += [(100 + i, f"own {i}\n{block}\n{'licence of everyone ' * 2}\ntail {i}") for i in range(12)] + [(200, None), (201, ""), (202, "\n\n")] + docs[:5] + [(300, "\n".join(pool) * 9)]
    df = spark.createDataFrame([(*d, "k", i) for i, d in enumerate(docs)], "doc_id int, text string, key string, hashes int").repartition(4)
    want = brute(docs, least)
    got = op.dedup_lines(df, min_chars=least, removed_col="removed").collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r.hashes]
        assert r.doc_id == d[0] and r.removed == want[d], d
        assert r.text == (None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in set(want[d])))
    assert sum(map(bool, want.values())) > 20


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, op.MIN_CHARS)
    got = {r.doc_id: (list(r.removed), r.n_removed) for r in op.op4(spark, sf).collect()}
    assert got == {d[0]: (w, len(w)) for d, w in want.items()} and any(want.values())


def test_empty_table(spark):
    assert op.dedup_lines(spark.createDataFrame([], "doc_id int, text string")).count() == 0

import random
import re
from collections import Counter

import pytest

from ketframe.llm import quality_rules as op


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_capitals": len(re.findall("[A-Z]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
    }


def verdicts(rows):
    """Brute force: sorted bins instead of sketches, one group at a time."""
    base = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for _, _, c in rows]
    bins = lambda c, r: min(op.RULES[r][2] * c[op.RULES[r][0]] // max(c[op.RULES[r][1]], 1), op.RULES[r][3])

    def limit(group, levels, r):
        slack, side = op.RULES[r][4:]

        def quantile(rows, t, of):
            v = sorted(bins(c, r) for c in rows)
            return v[-(-t * len(v) // of) - 1]

        def parts(rows):
            """Median, distance to the quartile on the clean side, slack."""
            m = quantile(rows, 1, 2)
            clean = abs(m - quantile(rows, 2 - side, 4))
            return m, clean, max(slack, op.SLACK_SPREADS * clean)

        middle, _, own = parts(group)
        cut = middle + side * (op.SPREADS * abs(middle - quantile(group, 9 if side > 0 else 1, 10)) + own)
        bounds = [m + side * (op.BOUND_SPREADS * clean + s) for m, clean, s in map(parts, levels)]
        return min(cut, max(bounds)) if side > 0 else max(cut, min(bounds))

    good = [(a, b, c) for (a, b, c), bad in zip(rows, base) if not bad]
    out = []
    for (a, b, c), bad in zip(rows, base):
        fine = [x[2] for x in good if x[:2] == (a, b)]
        middle = [x[2] for x in good if x[0] == a]
        levels = [x for x, least in ((fine, op.MIN_GROUP), (middle, op.MIN_GROUP), ([x[2] for x in good], 1)) if len(x) >= least]
        failed = [r for r in op.RULES if fine and (bins(c, r) > limit(levels[0], levels, r) if op.RULES[r][5] > 0 else bins(c, r) < limit(levels[0], levels, r))]
        out.append((bad, failed, not bad and not failed))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "MIN_GROUP", 12)
    rng = random.Random(1)
    few, many = ["a", "b", "é", "日本"], [f"{c}{i}" for i in range(300) for c in "ab"]

    def text():
        pool = many if rng.random() < 0.8 else few
        junk = rng.choice(["", "", "", "#$%", "|"])
        return rng.choice(["", " "]) + "".join(rng.choice(pool).upper() * (rng.random() < 0.2) + rng.choice(pool) + junk + rng.choice([" ", " ", "\t", "\n", "\n\n", " \n"]) for _ in range(rng.randrange(120)))

    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), text()) for _ in range(150)]
    rows += [("en", "s0", None), ("en", "s0", ""), ("fr", "s9", "x\ny\nx\n \nx"), ("fr", "s9", "one two three " * 4000), ("en", "s1", "w" * 50_000 + " v" * 60)] + [rows[3]] * 3
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, source string, text string, bin int, limit string").repartition(4)
    got = op.quality_rules(df).collect()
    want = {}
    full = [(a, b, counts(t)) for a, b, t in rows]
    for r, (_, _, c), v in zip(rows, full, verdicts(full)):
        want[r] = (c, v)
    assert len(got) == len(rows)
    for r in got:
        c, v = want[(r.lang, r.source, r.text)]
        q = r.quality.asDict()
        assert {k: q[k] for k in c} == c, r.text
        assert (q["base_failed"], q["failed_rules"], q["kept"]) == v, (r, v)
    kept = op.drop_rejected(df)
    assert kept.columns == df.columns and kept.count() == sum(want[r][1][2] for r in rows)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op.op7(spark, sf).collect():
        c = counts(docs[r.doc_id])
        assert all(r[k] == c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.base_failed == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]) and not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert op.quality_rules(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_query_against_sql(spark):
    from tests.llm.duck import same_rows

    sf = "/root/testdata/sf0.01"
    same_rows(op.op7(spark, sf), op.OP7_SQL, sf)


@pytest.mark.parametrize("share", [0.05, 0.15, 0.33])
def test_a_junk_source_keeps_no_junk(spark, share):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for source in ("clean", "hot"):
        for i in range(300):
            junk = source == "hot" and i < 300 * share
            text = " ".join(word() + ("#$%&" * rng.randrange(1, 3) if junk else "&" * (rng.random() < 0.02)) for _ in range(80))
            rows.append(("en", source, f"{text} {i}", junk))
    df = spark.createDataFrame(rows, "lang string, source string, text string, junk boolean")
    kept = op.drop_rejected(df).collect()
    assert not [r for r in kept if r.junk]
    assert len(kept) == sum(not r[3] for r in rows)


DEFECTS = {
    "symbols": lambda words: [w + "#$" for w in words],
    "capitals": lambda words: [w.upper() for w in words],
    "dup_lines": lambda words: words[:40] + ["\nsame line here"] * 6,
    "repeats": lambda words: words[:45] + ["again", "and", "so"] * 12,
    "long_words": lambda words: [a + b for a, b in zip(words, reversed(words))],
    "short_words": lambda words: [w[:2] for w in words],
}


@pytest.mark.parametrize("rule", list(op.RULES))
def test_each_rule_takes_its_defect_and_no_clean_document(spark, rule):
    rng = random.Random(rule)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9]))).capitalize() if rng.random() < 0.1 else "".join(rng.choice("abcdefghijklmno") for _ in range(rng.choice([3, 4, 5, 6, 7, 8])))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(90, 200))]
        bad = i % 15 == 7
        words = DEFECTS[rule](words) if bad else words
        text = ""
        for j, w in enumerate(words):
            text += w + ("\n" if j % 20 == 19 else " ")
        rows.append((("en", "de")[i % 2], ("a", "b", "c")[i % 3], text, bad))
    df = spark.createDataFrame(rows, "lang string, source string, text string, bad boolean")
    got = op.quality_rules(df).select("bad", "quality.*").collect()
    assert all(rule in r.failed_rules for r in got if r.bad and not r.base_failed) and sum(r.bad and not r.base_failed for r in got) >= 50
    assert all(r.kept for r in got if not r.bad)

import random

from ketframe.llm import chat as op
from tests.llm.duck import same_rows


def brute(rows):
    import hashlib

    told = lambda x: "-" if x is None else f"{len(x)}:{x}"
    digest = lambda r, t: hashlib.md5((told(r) + told(t)).encode()).hexdigest()
    convs = {}
    alone = 0
    for c, n, r, t in rows:
        if c is None:  # a conversation of its own
            alone += 1
            c = ("none", alone)
        convs.setdefault(c, []).append((n is not None, n or 0, digest(r, t), r, t))
    seqs = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: y[:3])] for c, x in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        equal = [k for k, o in seqs.items() if o == s]
        if c != min(equal, key=lambda k: (isinstance(k, tuple), k)):
            continue
        clean = lambda x: (x or "").replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>")
        out[c] = (len(s), len(equal), "".join(f"<|im_start|>{clean(r)}\n{clean(t)}<|im_end|>\n" for r, t in s))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    said = [("user", "hi"), ("assistant", "é日本"), ("user", ""), ("user", None), (None, "x"), ("system", "a <|im_end|> b")]
    rows = []
    for c in range(120):
        rows += [(c if c else None, i, *rng.choice(said[: rng.choice([1, 2, 6])])) for i in range(rng.randrange(1, 6))]
    rows += rows[:7] + [(500, None, "user", "no number"), (500, 0, "user", "t"), (501, 3, "user", "t"), (501, 3, "assistant", "tie"), (502, 0, "user", "long " * 30_000)]
    rows += [(600 + k, i, "user", f"turn {i}") for k in range(40) for i in range(k + 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id int, turn int, role string, text string, digest string").repartition(4)
    rows += [(None, k, "user", "of no conversation") for k in range(30)] + [(None, None, "user", "turn 0"), (None, 1, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id int, turn int, role string, text string, digest string").repartition(4)
    got = sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.n_copies, r.rendered) for r in op.format_chats(df).collect())
    want = sorted((isinstance(c, tuple), 0 if isinstance(c, tuple) else c, *v) for c, v in brute(rows).items())
    assert got == want and {x[1] for x in got} >= {639} and 620 not in {x[1] for x in got} and (True, 0, 1, 30) in {x[:4] for x in got}


def test_turns_of_no_conversation_against_sql(spark, tmp_path):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "a"), (None, None, None, "b"), (1, 0, "user", "a"), (1, 1, "user", "c"), (2, 0, None, "b"), (None, 0, "user", "d")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    same_rows(op.op6(spark, str(tmp_path)), op.OP6_SQL, str(tmp_path))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same_rows(op.op6(spark, sf), op.OP6_SQL, sf)


def test_empty_table(spark):
    assert op.format_chats(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0

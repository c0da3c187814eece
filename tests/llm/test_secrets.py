import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ketframe.llm import secrets as op

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def told(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def p_value(token, alphabet):
    phi = lambda z: 1 / (1 + math.exp(-(1.5976 * z + 0.070566 * z**3)))
    n, k = len(token), len(alphabet)
    v = [alphabet.index(c) + 1 for c in token]
    x2 = k / n * sum(x * x for x in Counter(token).values()) - n
    df = k - 1
    chi = 1 - phi((max(x2, 0) / df) ** (1 / 3) / math.sqrt(2 / (9 * df)) - (1 - 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    up = [x > k / 2 for x in v]
    a, b = sum(up), n - sum(up)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    pr = 2 * (1 - phi(abs((runs - 2 * a * b / n - 1) / math.sqrt(var)))) if var > 0 else 0
    mean = sum(v) / n
    ss = sum((x - mean) ** 2 for x in v)
    ps = 2 * (1 - phi(abs((sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / ss + 1 / n) * math.sqrt(n)))) if ss else 0
    half = -sum(math.log(max(x, 1e-12)) for x in (chi, pr, ps))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text):
    out = []
    for m in re.finditer(op.TOKEN, text or ""):
        for name, (alphabet, form) in op.ENCODINGS.items():
            if re.match(form, m[0]):
                out.append((m.start(), m.end(), name, max(x for x in op.LENGTHS if x <= len(m[0])), p_value(m[0], alphabet), m[0]))
                break
    return out


def least_of(values):
    """(number of values, lowest threshold or None) of a class's different values {token: p}."""
    bins = [min(int(p * op.BINS), op.BINS - 1) for p in values.values()]
    upper = 1 + sum(b >= op.BINS // 2 for b in bins)
    ok = [t for t in range(1, op.BINS // 2 + 1) if sum(b >= t for b in bins) * (1 - op.FALSE_SHARE) <= 2 * upper * (op.BINS - t) / op.BINS]
    return len(bins), ok[0] / op.BINS if ok else None


def all_spans(texts):
    tokens = [candidates(t) for t in texts]
    classes, encodings, whole = {}, {}, {}
    for _, _, e, size, p, token in (x for row in tokens for x in row):
        for values in (classes.setdefault((e, size), {}), encodings.setdefault(e, {}), whole):
            values[token] = p
    least = {}
    for (e, size), values in classes.items():
        fits = [least_of(v) for v in (values, encodings[e])]
        least[e, size] = next((t for n, t in fits if n >= op.MIN_CLASS), least_of(whole)[1])
    out = []
    for t, row in zip(texts, tokens):
        known = base(t)
        extra = [(a, 3, b) for a, b, e, s, p, _ in row if least[e, s] is not None and p >= least[e, s] and not any(x < b and a < y for x, _, y in known)]
        out.append(sorted(known + extra))
    return out


def made(rng):
    secret = "".join(rng.choice(op.UPPER + op.LOWER + op.DIGITS) for _ in range(rng.randrange(1, 60)))
    parts = [
        lambda: rng.choice(["Token", "api_key", "APIKEY", "password", "passwd", "secret", "tokens", "x"]) + rng.choice(["", '"', "'"]) + rng.choice([" ", "", "  "]) + rng.choice(["=", ":", " "]) + rng.choice(["", " ", "\n"]) + rng.choice(["", '"']) + secret[: rng.randrange(12)],
        lambda: "AKIA" + secret[: rng.randrange(30)].upper() + rng.choice(["", "AKIA", "a"]),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(10, 60))),
        lambda: secret, lambda: "ab1" * rng.randrange(5, 20), lambda: rng.choice(["é日本", "\U0001f600", "the", "of", "\n", "\x00"]),
    ]
    return "".join(rng.choice(parts)() + rng.choice([" ", "", ", ", "\n"]) for _ in range(rng.randrange(14)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(250)] + [None, "", "token=", "token=secret=abcdefg", "password: token: abcdefgh", "AKIAAKIA" + "Z" * 16, "token = abcdef " * 700, "é" * 10_000 + " secret:abcdefg"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, base int").repartition(4)
    want = all_spans(texts)
    got = {r.doc_id: [(s.start, op.KINDS.index(s.kind), s.end) for s in r.secrets] for r in op.find_secrets(df).collect()}
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    assert sum(k == 3 for w in want for _, k, _ in w) > 20


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: s for d, s in zip(docs, all_spans([d.text for d in docs]))}
    for r in op.op1(spark, sf).collect():
        w = want[r.doc_id]
        known = [x for x in w if x[1] < 3]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in w) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(told(known).encode()).hexdigest() and r.spans == told(w)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_without_tokens(spark, rows):
    assert [r.secrets for r in op.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [[] for _ in rows]


def test_false_discoveries(spark):
    """Random values are found, and of what is found in each class few are others; thin classes too."""
    rng = random.Random(11)
    words = ["server", "Config", "Default", "user", "Handler", "Request", "http", "Factory", "node", "Image", "Backup", "index", "Value", "Parser"]
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hidden = [draw(op.ENCODINGS[e][0], n) for e, n, times in (("base62", 32, 300), ("base64", 44, 300), ("HEX", 40, 200), ("base32", 32, 100), ("lower36", 30, 1), ("upper36", 24, 3)) for _ in range(times)]
    plain = ["".join(rng.choice(words) for _ in range(6)) + str(rng.randrange(2000)) for _ in range(600)]
    plain += [f"{rng.randrange(10**4):04}".join(["ABCD"] * 6) for _ in range(200)] + ["".join(f"{k + j:02X}" for j in range(16)) for k in range(160, 240)] + ["a1B2" * k for k in range(5, 30)]
    texts = [f"see {x} here" for x in (hidden + plain) * 2]
    rows = op.find_secrets(spark.createDataFrame(enumerate(texts), "doc_id int, text string").repartition(4)).collect()
    known = set(hidden)
    found = {r.text[4:-5] for r in rows if any(s.kind == "random" for s in r.secrets)}
    of_form = {x for x in hidden if candidates(x)}  # a draw without a digit, say, has no encoding
    assert len(of_form) > 850 and len(found & known) >= 0.95 * len(of_form)
    assert len(found - known) <= op.FALSE_SHARE * len(found)
    assert all(x in found for x in of_form if len(x) in (24, 30) and candidates(x)[0][4] >= 0.05)


def test_one_value_in_a_corpus(spark):
    secret, word = "9F3A0C7E51B2D84466EA19C0F7352BD88E01A4D6", "ABAB1212" * 5
    df = spark.createDataFrame([(i, f"{secret} {word}") for i in range(5)], "doc_id int, text string")
    assert all([(s.kind, s.start, s.end) for s in r.secrets] == [("random", 0, 40)] for r in op.find_secrets(df).collect())


def test_time_grows_with_length(spark):
    import time

    rng = random.Random(3)
    long = "".join(rng.choice(op.ENCODINGS["base64"][0]) for _ in range(1_000_000))
    many = "\n".join(f"token = {long[k:k + 40]}" for k in range(0, 400_000, 40))
    df = spark.createDataFrame([(1, long), (2, many)], "doc_id int, text string")
    began = time.time()
    rows = {r.doc_id: r.secrets for r in op.find_secrets(df).collect()}
    assert [(s.kind, s.end) for s in rows[1]] == [("random", 1_000_000)] and len(rows[2]) >= 10_000
    assert time.time() - began < 120

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ketframe.llm import token_alignment as op

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  spaces ", " lead", "trail ", "tab\tnew\nline \n x", "marker ▁ in it", "é日本語 \U0001f600 ñ", "<|endoftext|> <s> </s> <0x41> <unk>",
    "\x00 nul", "it's we'll 12345 $$$", "a b", "a b", "é combining", " hard space", "x\r\ny", "no break", "﻿bom", "ﬁ ligature ½",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def printable_bytes():
    """The alphabet as the byte-level vocabulary's makers state it."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}


def slow(libraries, texts):
    """Every document's tokens by whole calls, links by comparing all byte ranges, counts by sets."""
    a, b = libraries
    alphabet = printable_bytes()
    docs = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(([], [], [], [], []))
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for x in parts:
                out.append((at, at + len(x)))
                at += len(x)
            ranges.append(out)
        links = [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e] if len(text) < 3000 else fast_links(*ranges)
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        group = [[[], []] for _ in ends]
        for side, ids in enumerate((ids_a, ids_b)):
            for i, (_, e) in zip(ids, ranges[side]):
                group[bisect.bisect_left(ends, e)][side].append(i)
        docs.append((ids_a, ids_b, links, group, ends))
    count = Counter()
    for ids_a, ids_b, links, _, _ in docs:
        count.update({(ids_a[i], ids_b[j]) for i, j in links})
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for ids_a, ids_b, links, group, _ in docs:
        n = [(ids_a[i], count[ids_a[i], ids_b[j]]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in group)
        out.append((len(ids_a), len(ids_b), len(group), len(links), sum(best[i] == c for i, c in n), sum(c for _, c in n), hashlib.sha256(text.encode()).hexdigest() if group else ""))
    return out, docs


def fast_links(a, b):
    out, j = [], 0
    for i, (s, e) in enumerate(a):
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((i, k))
            k += 1
    return out


def frame(spark, texts, first=0):
    rows = [(None if k == 3 else k + first, t, "x", 1, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, a string, row int, ids string")


def check(spark, libraries, texts):
    want, _ = slow(libraries, texts)
    got = op.alignment_counts(frame(spark, texts).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    by = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(by) == len(texts) == got.count()
    for k, w in enumerate(want):
        assert by[None if k == 3 else k] == w, texts[k]


def test_odd_texts(spark, libraries):
    check(spark, libraries, ODD)


def test_documents(spark, libraries, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = slow(libraries, [r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in op.op11(spark, sf).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want)}
    assert sum(w[3] for w in want) == sum(w[0] + w[1] - w[2] for w in want) > 100_000


def test_spans_tables_and_blocks_change_nothing(spark, libraries, monkeypatch):
    for name, value in (("SPAN", 7), ("TABLE_CHUNKS", 3), ("CALL_CHUNKS", 2), ("LOOKUP", 150), ("TASK_PAIRS", 5)):
        monkeypatch.setattr(op, name, value)
    check(spark, libraries, [*ODD, "unbelievable antidisestablishmentarianism " * 4])


def test_long_text(spark, libraries):
    check(spark, libraries, ["word other, " * 10_000 + "end", "x" * 5_000])


def test_groups_and_links(spark, libraries, monkeypatch):
    monkeypatch.setattr(op, "SPAN", 11)
    texts = [t for t in ODD if t]
    _, docs = slow(libraries, texts)
    rows = sorted(op.align(frame(spark, texts, 100), A, B).collect(), key=lambda r: (r.row, r.at))
    for k, (ids_a, ids_b, links, _, ends) in enumerate(docs):
        mine = [r for r in rows if r.doc_id == (None if k == 3 else k + 100)]
        assert [i for r in mine for i in r.a] == list(ids_a) and [i for r in mine for i in r.b] == list(ids_b)
        assert [e for r in mine for e in r.group_ends] == ends
        got, x, y = [], 0, 0
        for r in mine:
            got += [(x + p.a, y + p.b) for p in r.links]
            x, y = x + len(r.a), y + len(r.b)
        assert sorted(got) == sorted(links)


def test_empty_table(spark):
    assert op.alignment_counts(frame(spark, []), A, B).count() == 0 and op.align(frame(spark, []), A, B).count() == 0


def test_packing():
    rng = np.random.default_rng(0)
    for top in (1, 200, 60_000, 2**31, 2**40):
        for n in (0, 1, 1000):
            v = rng.integers(0, top, n)
            assert (op.unpack(op.pack(v)) == v).all()


def test_new_chunks_go_to_the_libraries_together(spark, sf):
    """Chunks of whole texts cut from joined ones, odd ones among them, have the ids that they have alone, by few calls."""
    from pathlib import Path

    both = op.Tokenizers(Path(A).read_text(), Path(B).read_bytes())
    words = sorted({c for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text for c in op.chunks(r.text)})[:5000]
    for at, odd in zip(range(0, len(words), 300), [x for x in ODD if x is not None]):
        words.insert(at, odd)
    alone = both.encode(words)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, f=both.a, **k):
            asked.extend(texts)
            return f.encode_batch_fast(texts, **k)

    both.a = Counted()
    good, ids, many = both.encode_chunks(words)
    assert good.tolist() == [x[2] for x in alone]
    for side in range(2):
        assert many[side].tolist() == [len(x[side]) for x in alone]
        assert ids[side].tolist() == [i for x in alone for i in x[side]]
    assert len(asked) < len(words) / 2

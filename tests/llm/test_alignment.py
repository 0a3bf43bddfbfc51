"""Cross-tokenizer alignment against plain Python, and its shortcuts against whole encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from fixtures import SCHEMA, prose, rows, table

from bomrec.llm import alignment

ODD = [
    "<|endoftext|> and </s> <s> <unk> <0x41>", "a\x00b", "▁ under", "tabs\t\tand\nlines \r\n\n end  ", "日本語 のテキスト", "🙂🙂 smile",
    "don't  we'll 'S ''s", "x" * 5000, " " * 3000 + "y", "  nbsp em", "Straße ÉTÉ 12345 a1b2", "\x1c\x1d sep", "áé combining",
    "   ", "\n", "ﬁ ½ ①", "...!!!???", "İstanbul", "a  b   c    d",
]


@pytest.fixture(scope="module")
def plain():
    first = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def plain_alignment(some, plain):
    first, second = plain
    back = alignment.byte_alphabet()
    docs, count = [], Counter()
    for doc_id, text, *_ in some:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [alignment.piece_bytes(second.id_to_piece(i)) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            docs.append((doc_id, [], [], []))
            continue
        ends = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for c in cuts:
            groups.append(tuple([i for i, e in zip(ids, es, strict=True) if before < e <= c] for ids, es in ((a, ends[0]), (b, ends[1]))))
            before = c
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        count.update(set(links))
        docs.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if not d[1]:
            out.append((d[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in d[3])
        links = d[4]
        out.append((d[0], len(d[1]), len(d[2]), len(d[3]), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return out, count


def odd_rows():
    return [*rows(n=36), *[(100 + i, t, "en", "s") for i, t in enumerate(ODD)], (200, " ".join(ODD) * 20, None, None)]


@pytest.mark.parametrize("block", [2_000, alignment.BLOCK_BYTES])
def test_alignment(spark, plain, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    some = odd_rows()
    got, pairs = alignment.align(table(spark, some, clashing=True))
    wanted, count = plain_alignment(some, plain)
    assert Counter(tuple(r) for r in got.collect()) == Counter(wanted)
    assert {(r["id_a"], r["id_b"]): r["n_docs"] for r in pairs.collect()} == dict(count)
    assert any(w[1] == 0 and t for w, (_, t, *_) in zip(wanted, some, strict=True))


def test_nothing_to_align(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA))[0].collect() == []
    got = alignment.align(spark.createDataFrame([(1, None, "en", "s"), (1, "", None, None)], SCHEMA))[0].collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_encode_as_whole_texts(plain):
    rng = random.Random(2)
    letters = "abcdefghij    \n\t.,'\"!?-0123ÄÖéß —…’日🙂▁s t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(600)] + [prose(rng, 300)] + ODD
    tables = alignment.Loaded(alignment.Pair())
    for some in (texts, texts[::-1]):
        first, second = tables.encode(pa.array(some))
        assert first.to_pylist() == [e.ids for e in plain[0].encode_batch([f" {t}" for t in some], add_special_tokens=False)]
        assert second.to_pylist() == plain[1].encode(some)


def test_large_groups_are_joined_in_slices(monkeypatch):
    rng = random.Random(1)
    t = [pa.table({"group": sorted(rng.randrange(4) for _ in range(600)), "id": pa.array([rng.randrange(50) for _ in range(600)], pa.int32())}) for _ in range(2)]
    wanted = Counter((g // 2, x * 32_000 + y) for g, x in zip(*map(pa.ChunkedArray.to_pylist, t[0].columns), strict=True)
                     for h, y in zip(*map(pa.ChunkedArray.to_pylist, t[1].columns), strict=True) if g == h)
    for rows_, large in ((1 << 22, 64), (100, 1 << 40), (1000, 1)):
        monkeypatch.setattr(alignment, "JOIN_ROWS", rows_)
        monkeypatch.setattr(alignment, "LARGE_GROUP", large)
        got = alignment.linked(*t, pa.array([0, 0, 1, 1]), 32_000)
        assert {(r["doc"], r["pair"]): r["times"] for r in got.to_pylist()} == wanted

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from llm_edges import SF_DIR, edge, empty, pairs  # noqa: F401
from tokenizers import Tokenizer

from tillvault.llm import packing
from tillvault.llm.queries import op1_packing


def check(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in docs]
    wanted = Counter((i, zlib.crc32(a.tobytes()), len(a)) for i, a in ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    # Every id of every document lies in exactly one piece.
    for doc, own in pieces.items():
        arrays = [a for i, a in ids if i == doc]
        assert sum(r.length for r in own) == sum(map(len, arrays))
        for r in own:
            cuts = [a[r.start : r.start + r.length] for a in arrays if len(a) == r.doc_tokens]
            assert r.ids_crc32 in [zlib.crc32(c.tobytes()) for c in cuts]
        if len(arrays) == 1:
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
    assert set(pieces) == {i for i, _, _ in wanted}
    padded = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        total = sum(r.length for r in own)
        assert total <= 1024 and total <= own[0].tier and len({r.step_group for r in own}) == 1
        padded += total not in packing.TIERS
    return padded


def test_every_id_is_packed_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    df = op1_packing(spark, SF_DIR)
    assert check(df.collect(), docs) <= df.rdd.getNumPartitions()


def test_edge_cases(edge, empty, pairs):
    df = packing.pack_documents(edge)
    assert check(df.collect(), pairs) <= df.rdd.getNumPartitions()
    assert packing.pack_documents(empty).isEmpty()


def test_ids_of_the_pieces(edge):
    for r in packing.pack_documents(edge.filter("doc_id IN (0, 7, 12)"), with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_words_have_the_tokenizers_ids():
    fast, slow = packing.WordIds("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), packing.WordIds("byte_bpe_50k.json", None)
    for text in ("", " ", "a", "a  b", "it's 3.5%\n\nOk. Word\nNext,\tx ", "naïve élan ŒUVRE", "漢字 ok", "a b  c", "end. \n"):
        exact = slow.tokenizer.encode(text, add_special_tokens=False).ids
        for coder in (fast, slow):
            assert np.frombuffer(coder.of(text), "<u4").tolist() == exact, text


def test_step_groups_are_balanced():
    windows = [(1024, [(0, 0, np.zeros(n, "<u4"), n) for n in sizes]) for sizes in [(1024,)] * 16 + [(128,) * 8] * 16]
    groups = packing.step_groups(windows, 5)
    cost = Counter()
    for (_, pieces), group in zip(windows, groups):
        cost[group] += sum(len(p[2]) ** 2 for p in pieces)
    assert set(groups) == {5, 6} and max(cost.values()) == min(cost.values())


def test_added_tokens_are_the_tokenizers():
    """Texts that spell an added token get the ids the plain tokenizer gives."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = packing.WordIds("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>\nb  <|endoftext|>é", "plain <|endof text|>", "none"):
        assert np.frombuffer(words.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.of("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]

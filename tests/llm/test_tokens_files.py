import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import DOCS, ODD
from tokenizers import Tokenizer

from sievework.llm import idfiles, lengths, mixing, packing
from sievework.llm import tokens as tk

NAMES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]

TRICKY = [
    "", " ", "a", " a", "a ", "  a  b ", "a\n b", "a \nb", "a\nb", "a\n\nb", "don't it's 'tis 's", "x's y're", "é à ü", "α Σας ΟΔΟΣ", "日本語 テスト",
    "a 1 22 333 b2", "İ i̇ ǅ", "<|endoftext|> <|startoftext|>", "end <|endoftext|> more <|startoftext|>", "a <|ENDOFTEXT|> b c", "x<|endoftext|>y z  <| endoftext|>", "A\t B", "é a ́b", "　 x", "a|b | c", "à\u0085 b", "é—d … e",
    "﻿bom x", "ÀÉ Ü ß ẞ", "a,b ,c, d.\nE", "a\xa0 b", "x   y", "1.5 $3,000.", "ééé é", "zé é z",
]


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "words_only"), NAMES)
def test_pieces_give_the_tokenizers_ids(spark, sf, name, words_only):
    path = public_tokenizers.path(name)
    texts = TRICKY + [t or "" for _, t in ODD] + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    enc = tk.encoder(path, words_only)
    column = pa.array([t.encode() for t in texts], pa.large_binary())
    ids, at = enc.ids(column)
    assert enc.lengths(column).tolist() == np.diff(at).tolist()
    ref = Tokenizer.from_file(path)
    for i, e in enumerate(ref.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i][:80]


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50_257, n) for n in (1, 2, 3, 100, mixing.BLOCK, mixing.BLOCK - 1, 0)]
    blocks += [np.zeros(1000, int), np.full(500, 131_071), np.arange(1024), rng.integers(0, 2, 900), np.tile([5, 9, 300], 300)]
    coded = mixing.encode(blocks)
    for got, want in zip(mixing.decode(coded, [len(b) for b in blocks]), blocks, strict=True):
        assert got.tolist() == want.tolist()
    assert len(coded[-1]) < 100  # what follows a known context costs little
    assert mixing.encode(blocks[3:4]) == coded[3:4]  # a block depends on no other


def test_ids_of_one_class_share_its_bits():
    """Order 0 learns the two bits below an id's first one as well, and digits of an id move once."""
    rng = np.random.default_rng(2)
    blocks = [rng.integers(512, 640, mixing.BLOCK) for _ in range(40)] + [rng.integers(0, 1 << 17, mixing.BLOCK) for _ in range(40)]
    moves, settle = [], mixing.Writer.settle
    mixing.Writer.settle = lambda self, n: (moves.append(n), settle(self, n))
    try:
        coded = mixing.encode(blocks)
    finally:
        mixing.Writer.settle = settle
    assert moves == [len(blocks)] * mixing.BLOCK
    assert sum(map(len, coded[:40])) < 40 * mixing.BLOCK  # seven bits are equally likely
    for got, want in zip(mixing.decode(coded, [len(b) for b in blocks]), blocks, strict=True):
        assert (got == want).all()


def test_more_pieces_are_remembered_where_asked():
    enc = tk.encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=idfiles.REMEMBERED)
    assert tk.encoder(public_tokenizers.path("byte_bpe_50k.json")) is enc
    assert enc.remembered == idfiles.REMEMBERED > tk.REMEMBERED


def test_new_words_are_split_many_at_once():
    """One call of the model for many new words, and the ids of each are those it has alone."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tk.Encoder(path, False)
    assert enc.apart and not tk.Encoder(public_tokenizers.path("word_bpe_49k.json"), True).apart
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abeinorstzäéñßÿ"), rng.integers(1, 14))) for _ in range(1000)}
    calls, model = [], enc.model

    class Model:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    enc.model = Model()
    text = " " + " ".join(words) + " x\u00a0y \u00a0 \u00aa\u00b5\u00ba"
    ids, at = enc.ids(pa.array([text.encode()], pa.large_binary()))
    assert ids.tolist() == ids_of(path, text) and at.tolist() == [0, len(ids)]
    assert len(calls) < len(words) / tk.TOGETHER + 20


def test_remembered_pieces_are_bounded():
    enc = tk.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    enc.remembered = 50
    for k in range(20):
        text = " ".join(f"a{'bcdefghij'[j % 9] * (j // 9 + k)}" for j in range(30))
        assert enc.ids(pa.array([text.encode()], pa.large_binary()))[0].tolist() == ids_of(public_tokenizers.path("byte_bpe_50k.json"), text)
        assert len(enc.known) <= enc.remembered


def test_learning_is_left_to_few_steps():
    """A block's mixer and frequencies count and renew at its start alone; what they learnt serves the rest."""
    calls, count, renew = [], mixing._Mixer.count, mixing._Mixer.renew
    mixing._Mixer.count = lambda self, right: (calls.append("count"), count(self, right))
    mixing._Mixer.renew = lambda self, n: (calls.append("renew"), renew(self, n))
    blocks = [np.tile([5, 9, 300, 40_000], mixing.BLOCK // 4)] * 3
    try:
        coded = mixing.encode(blocks)
    finally:
        mixing._Mixer.count, mixing._Mixer.renew = count, renew
    assert calls.count("count") <= mixing.BLOCK // 4 and calls.count("renew") <= 4
    assert [b.tolist() for b in mixing.decode(coded, [len(b) for b in blocks])] == [b.tolist() for b in blocks]


def test_quotients_are_whole():
    """What the reader divides lies below 2^48, where the floor of a quotient of doubles is that of the integers."""
    rng = np.random.default_rng(5)
    part = np.concatenate([rng.integers(1, 1 << k, 2000) for k in (4, 16, 24, 32, 38)])
    times = rng.integers(0, 1 << 10, len(part))
    for code in (part * times, np.maximum(part * times - 1, 0), part * times + part - 1, np.full(len(part), (1 << 48) - 1)):
        assert ((code / part).astype(np.int64) == code // part).all()


def test_carries_reach_earlier_digits():
    rng = np.random.default_rng(1)
    blocks = [rng.choice([1, 2, 65_535, 65_536], 700, p=[0.97, 0.01, 0.01, 0.01]) for _ in range(300)]
    for got, want in zip(mixing.decode(mixing.encode(blocks), [700] * 300), blocks, strict=True):
        assert (got == want).all()


def test_damage_is_noticed():
    data = idfiles.pack_block(np.zeros(1, idfiles._ENTRY), 3, mixing.encode([np.array([1, 2, 3])])[0])
    assert idfiles.open_block(data)[1] == 3
    for i in range(len(data)):
        with pytest.raises(idfiles.BadBlock):
            idfiles.open_block(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(idfiles.BadBlock):
        idfiles.open_block(data[:-1])


def test_joined_checksums():
    a, b = b"some bytes", b"and more of them"
    assert idfiles.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert idfiles.joined_crc(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_files_of_documents(spark, table, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(ODD + [(5, "again")] * 3, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    got = sorted(idfiles.encoded_documents(table(DOCS, rows), path).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = np.array([*ids_of(path, text or ""), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert idfiles.encoded_documents(table(DOCS, []), path).count() == 0


def test_pieces_can_be_read_back_with_ids(spark, table, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "ids")
    idfiles.write_ids(table(DOCS, ODD[4:]), folder, path)
    parts = sorted(idfiles.read_pieces(spark, folder, True).collect(), key=lambda r: (r.part, r.number, r.block))
    found = {}
    for r in parts:
        found.setdefault((r.part, r.number), []).append(np.frombuffer(r.ids, "<u4"))
    want = sorted([*ids_of(path, t or ""), 0] for _, t in ODD[4:])
    assert sorted(np.concatenate(v).tolist() for v in found.values()) == want


def test_histogram_answers(spark, table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ODD + [(40, "two words")] * 30
    sizes = sorted(len(ids_of(path, t or "")) for _, t in rows)
    hist = lengths.histogram(lengths.encoded_lengths(table(DOCS, rows), path))
    got = {r.length: r for r in hist.collect()}
    assert sorted(got) == sorted(set(sizes))
    for n, r in got.items():
        cut = sum(min(s, n) for s in sizes)
        assert (r.n_docs, r.n_docs_up_to, r.n_docs_over) == (sizes.count(n), sum(s <= n for s in sizes), sum(s > n for s in sizes))
        assert (r.tokens_up_to, r.truncated_total, r.lost_total) == (sum(s for s in sizes if s <= n), cut, sum(sizes) - cut)
    limits = [0, 1, 3, 1024, 5000, 10**9]
    for r in lengths.at_limits(hist, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect():
        assert r.truncated_total == sum(min(s, r.context_limit) for s in sizes)
        assert r.n_docs_fit == sum(s <= r.context_limit for s in sizes)
    for q in (0.01, 0.5, 0.9, 1.0):
        want = min(s for s in sizes if sum(x <= s for x in sizes) >= q * len(sizes))
        assert hist.agg(lengths.quantile(q)).first()[0] == want
    assert lengths.histogram(lengths.encoded_lengths(table(DOCS, []), path)).count() == 0


def test_packing_keeps_every_piece(spark, table):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = ODD + [(50, "hot " * 100)] * 100
    got = packing.packed_documents(table(DOCS, rows), path, capacity=512).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array([*ids_of(path, text or ""), 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want.append((str(doc_id), k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 2
    assert packing.packed_documents(table(DOCS, []), path).count() == 0


def test_islands_meet(spark, monkeypatch):
    """Many islands end with about as few sequences as one."""
    monkeypatch.setattr(packing, "ISLAND_TOKENS", 20_000)
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 4097, 600).tolist()
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECE)
    got = packing.pack(parts).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    one = packing.evolve([n for n in sizes if n < 4096], None, 4096, 0)
    assert len({r.sequence_id for r in got}) <= len(one.bins) * 1.05 + sizes.count(4096)


def test_search_improves_on_best_fit():
    """Crossover never loses or doubles an item, and finds a packing that best fit misses."""
    rng = np.random.default_rng(7)
    sizes = []
    for _ in range(30):  # bins that can be filled exactly, cut into three
        a, b = sorted(rng.integers(200, 3900, 2).tolist())
        sizes += [a, b - a, 4096 - b] if a < b else [a, 4096 - a]
    sizes = [s for s in sizes if s]
    found = packing.evolve(sizes, None, 4096, 1)
    assert sorted(i for items in found.bins for i in items) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) + free == 4096 for items, free in zip(found.bins, found.free, strict=True))
    first = packing.Bins(sizes, 4096)
    first.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    assert packing._fitness(found) <= packing._fitness(first)

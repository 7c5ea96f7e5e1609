import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelkit.llm import packing, queries, tokens, units
from panelkit.llm.units import Encoder, TokenCounter, single_token_strings
from tests.llm.common import empty, odd, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
COUNTER = TokenCounter(PATH, single_token_strings(PATH))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


BITS = ["a", " ", " b", " \n", "\r\n", "x y", "  ", "\n\nq", "\t", "<|endoftext|>", "　z", "\x1cq!\x1c", "é", "it's", " 's", "\xa0", "12 3", "!!\x85?", "​", "😀 "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS) | st.text(max_size=6), max_size=12).map("".join))
def test_pieces_encode_as_the_whole_text(text):
    want = ids(text)
    assert np.frombuffer(next(ENCODER.ids([text])), "<u4").tolist() == want
    assert next(COUNTER.counts([text])) == len(want)


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([*BITS, "don't,", "(x)", "Жé.", "é\u2014 ", " \n "]), max_size=9).map("".join) | st.none(), max_size=9),
    st.sampled_from([1, 40, 1_000_000]),
)
def test_texts_encoded_together_do_not_meet(texts, block):
    before, units.BLOCK = units.BLOCK, block
    try:
        got = [np.frombuffer(b, "<u4").tolist() for b in Encoder.ids(ENCODER, texts)]
    finally:
        units.BLOCK = before
    assert got == [ids(t) for t in texts]


def test_equal_pre_tokens_are_looked_up_once_a_block():
    asked = []

    class Counting(units.Remembered):
        def __getitem__(self, token):
            asked.append(token)
            return super().__getitem__(token)

    enc = Encoder(PATH)
    enc.tokens = Counting(enc._pre_token)
    texts = ["one two, (three) four-five\n" * 200, "one two" * 100, "", None]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [ids(t) for t in texts]
    assert len(asked) < 30


def test_memory_of_pre_tokens_is_bounded_by_their_size():
    some = units.Remembered(lambda token: token.encode() * 50, limit=100_000)
    for i in range(5_000):
        assert some[f"{i:05}"] == b"%05d" % i * 50
    held = [*some.items(), *some.older.items()]
    assert sum(units.getsizeof(x) for pair in held for x in pair) <= 200_000 and len(held) > 200


def test_single_tokens_are_proven():
    some = random.Random(1).sample(sorted(COUNTER.single), 500)
    assert all(len(ids(s)) == 1 for s in some) and len(COUNTER.single) > 40_000


def test_counts_of_odd_rows(spark):
    got = sorted(tuple(r) for r in tokens.count_tokens(odd(spark), PATH).collect() if r.doc_id is not None)
    want = sorted(
        (r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 512) for r in odd_rows() if r[0] is not None
    )
    assert got == want and tokens.count_tokens(empty(spark), PATH).count() == 0


def test_other_tokenizer_is_encoded_text_by_text(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(odd(spark), path).collect()}
    for r in odd_rows():
        if r[0] is not None:
            assert got[r[0]] == len(other.encode(r[1] or "", add_special_tokens=False).ids)


def test_token_files_round_trip(spark):
    folder = tokens.token_folder(spark)
    tokens.write_token_files(odd(spark), PATH, folder)
    rows = sorted(tokens.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == sorted((r[0] for r in odd_rows()), key=lambda k: (k is not None, k))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = {r[0]: [*ids(r[1]), 0] for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r.key is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(want[r.key]), crc(want[r.key]))
    assert tokens.read_document(folder, 107).tolist() == want[107]
    assert tokens.read_document(folder, 99_999) is None
    arrays = {r.key: r.ids for r in tokens.read_ids(spark, folder).collect()}
    assert arrays[106] == want[106]


def test_documents_of_a_batch_share_lookups():
    """The words of many documents, as a task of the token files encodes them, are looked up a few times."""
    looked_up = 0

    class Counting(units.Remembered):
        def __getitem__(self, token):
            nonlocal looked_up
            looked_up += 1
            return super().__getitem__(token)

    enc = Encoder(PATH)
    enc.tokens = Counting(enc._pre_token)
    texts = [f"Ähnlich, same words.\nin all {i % 7}" for i in range(500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [ids(t) for t in texts]
    assert looked_up < 40


def test_no_documents_make_no_files(spark):
    folder = tokens.token_folder(spark)
    tokens.write_token_files(empty(spark), PATH, folder)
    assert tokens.read_token_files(spark, folder).count() == 0


def check_packing(rows, docs, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs:
        want = [*ids(r[1]), 0]
        got = sorted(by_doc[r[0]], key=lambda x: x.start)
        if r[0] is not None and len({x.start for x in got}) == len(got):
            at = 0
            for x in got:
                assert x.start == at and x.doc_tokens == len(want) and x.ids_crc32 == crc(want[at : at + x.length])
                at += x.length
            assert at == len(want)
    used = 0
    for some in by_sequence.values():
        at = 0
        for x in sorted(some, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
        used += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return used / (capacity * len(by_sequence))


def test_packing(spark, sf):
    pieces = packing.pack(packing.cut_documents(odd(spark), PATH, keep_ids=True)).withColumnRenamed("key", "doc_id")
    rows = pieces.collect()
    check_packing(rows, odd_rows())
    made = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for r in rows:
        assert crc(made[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    assert packing.pack(packing.cut_documents(empty(spark), PATH)).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(queries.op3_pack_sequences(spark, sf).collect(), docs) > 0.95


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_patterns_use_the_histogram_up(histogram):
    total = defaultdict(int)
    for pattern, n in packing.shortest_pack_first(histogram, 64):
        assert n > 0 and sum(pattern) <= 64
        for length in pattern:
            total[length] += n
    assert dict(total) == histogram

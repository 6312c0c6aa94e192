import os
import random

import pytest

from tallyfield.llm.bpe import ForcedBoundaryEncoder, decode_column, encode_column, read_ranks, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary file")
SPECIAL = ["", "<|endoftext|> and <|endoftext|>", "a" * 3000, "é" * 1500, " \n\t \r\n  x", "naïve café 👍🏽", "ab" * 2000 + " " * 500, "it's we'll I'd 12345 ٣٤"]


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), "rb") as f:
        return ForcedBoundaryEncoder(read_ranks(f.read()))


def test_equals_the_public_encoder(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=encoder.ranks, special_tokens={})
    rnd = random.Random(5)
    texts = SPECIAL + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 700), rnd.randrange(0x4E00, 0x9FFF)])) for _ in range(rnd.randrange(80))) for _ in range(500)]
    for t in texts:
        assert encoder.encode(t) == ref.encode_ordinary(t)


def test_long_fragments_merge_alike(encoder):
    for data in (b"abcabcabd" * 30, b"zzzz" * 40, "ü".encode() * 60):
        assert encoder._merge_long(data) == encoder.merge(data)


def test_column_keeps_rows_and_round_trips(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SPECIAL, None, None, "repeat", "repeat"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_column(df, "text", ["doc_id"])
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert len(ids) == len(rows) and ids[8] == [] and ids[0] == []
    back = {r.doc_id: r.text for r in decode_column(got, "ids", ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode_column(df.where("false"), "text", ["doc_id"]).count() == 0

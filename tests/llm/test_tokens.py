import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wayfold.llm import bpe, tokencount, tokenfile
from wayfold.llm.arrays import text_blocks

BITS = "' s t re ve ll d m r v l e \n \t 　 \xa0 é É ß 漢 字 1 23 ! 'S a x B ... = 😀 é ٣ Σ İ <| </w>".split(" ") + [" ", "  ", "<|endoftext|>"]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(3000)]
    return [*made, None, "", "a" * 3000, " " * 300, "=-" * 400, "the quick brown fox " * 3000]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spec(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def test_encode_and_decode(spark, documents, ranks, library):
    given = texts()
    coded = bpe.encode(documents(given), ranks, keep=["doc_id", "n_chars"], decoded="decoded")
    rows = sorted(bpe.decode(coded, ranks, decoded="again").collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in given]
    assert all(r.decoded.decode() == r.again.decode() == (t or "") for r, t in zip(rows, given))
    assert bpe.encode(documents([]), ranks).collect() == []


def test_prefix_table_appends_and_edits(ranks, library):
    vocabulary, rng = bpe.compile_ranks(ranks), random.Random(1)
    # One piece, so that the library does not part it.
    table = bpe.PrefixTable(vocabulary)
    text = ""
    for _ in range(40):
        more = "".join(rng.choice("theringandsouxq") for _ in range(rng.randrange(1, 9)))
        table.append(more.encode())
        text += more
        assert table.ids() == library.encode_ordinary(text)
    for _ in range(40):
        start = rng.randrange(len(text))
        stop = min(len(text), start + rng.randrange(5))
        new = "".join(rng.choice("thing") for _ in range(rng.randrange(5)))
        text = text[:start] + new + text[stop:]
        table.replace(start, stop, new.encode())
        assert table.ids() == library.encode_ordinary(text)
        assert table.counts[-1] == len(table.ids())
    long = bpe.PrefixTable(vocabulary, b"information" * 500)
    assert long.replace(20, 21, b"xx") < 600


@pytest.mark.parametrize(("chunk", "states"), [(512, 1 << 19), (7, 1 << 19), (2, 1 << 19), (1, 100)])
def test_counts_equal_the_library(chunk, states, monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    monkeypatch.setattr(tokencount, "STATES", states)
    sys._wayfold_once = {}
    vocabulary, library = tokencount.compile_file(spec("word_bpe_49k.json")), Tokenizer.from_str(spec("word_bpe_49k.json"))
    given = texts()
    found = []
    for _, _, data, offsets in text_blocks(pa.array(given, pa.string()), 50_000):
        found += tokencount.count_block(vocabulary, data, offsets).tolist()
    assert found == [len(e.ids) for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]


def test_chunk_maps_compose_in_any_order():
    vocabulary = tokencount.compile_file(spec("word_bpe_49k.json"))
    lower = tokencount.Transducer(vocabulary)
    data = np.frombuffer("it're we'll they'restive 12３ ab　c 'l 's ".encode() * 3, np.uint8)
    kinds = tokencount.byte_kinds(data)
    symbols, blank = tokencount.inputs(data, kinds), kinds == tokencount.SPACE
    words = lambda a, b: lower.words(data, a, b)
    rng = random.Random(2)
    for _ in range(30):
        cuts = np.array([0, *sorted(rng.sample(range(1, len(data)), 3)), len(data)])
        a, b, c, d = (tokencount.chunk_maps(symbols, blank, cuts[:-1], cuts[1:], words).rows([k]) for k in range(4))
        join = lambda x, y: tokencount.compose(x, y, words)
        whole = tokencount.chunk_maps(symbols, blank, cuts[:1], cuts[-1:], words)
        for total in (join(join(join(a, b), c), d), join(a, join(b, join(c, d))), join(join(a, b), join(c, d))):
            assert [x[0, tokencount.FREE] for x in total] == [x[0, tokencount.FREE] for x in whole]


def test_count_columns(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "é " * 3000, 2), (1, "Hello", 3)], "doc_id long, text string, n_tokens long")
    rows = tokencount.count_tokens(docs, spec("word_bpe_49k.json"), keep=["doc_id", "n_tokens"]).withColumnRenamed("n_tokens", "own").collect()
    assert sorted(r.own for r in rows) == [1, 2, 3]
    assert sorted((r.n_bytes, r.n_tokens_, r.over_limit) for r in rows) == [(0, 0, False), (5, 1, False), (9000, 3000, True)]


def test_token_files(spark, documents, tmp_path):
    given = texts()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = f"{tmp_path}/tokens"
    tokenfile.write_token_files(documents(given), folder, spec("byte_bpe_50k.json"), frame_ids=500, file_ids=4000)
    rows = sorted(tokenfile.with_starts(tokenfile.read_token_files(spark, folder)).collect(), key=lambda r: r.doc_id)
    expected = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in given]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == expected
    assert [r.start for r in rows] == np.cumsum([0, *map(len, expected)])[:-1].tolist()
    wanted = tokenfile.read_token_files(spark, folder, [5, 2999]).collect()
    assert {r.doc_id: zlib.crc32(r.ids) for r in wanted} == {k: zlib.crc32(np.array(expected[k], "<u4").tobytes()) for k in (5, 2999)}
    # Any reader of the public format can read a file: it is frames, the last of them skippable.
    part = next(p for p in sorted((tmp_path / "tokens").glob("part-*")) if p.stat().st_size)
    assert part.read_bytes()[-4:] == base64.b64decode("seqSjw==")


def test_readers_open_few_frames_and_notice_damage():
    writer = tokenfile.FileWriter(3, frame_ids=100, file_ids=10**9)
    for k in range(200):
        writer.add(k if k else None, np.arange(k, dtype=np.uint32))
    content = writer.finish() + tokenfile.CLOSING
    reader = tokenfile.FileReader(content)
    assert [(d, b, np.frombuffer(i, "<u4").tolist()) for d, b, i in reader.documents({150})] == [(150, sum(range(150)), list(range(150)))]
    assert reader.opened == 2 and len(reader.entries) > 50
    with pytest.raises(ValueError):
        tokenfile.FileReader(content[:-1])
    broken = bytearray(content)
    broken[reader.starts[reader.frame_of[150]] + 20] ^= 255
    with pytest.raises(Exception):
        list(tokenfile.FileReader(bytes(broken)).documents({150}))


def test_token_files_of_odd_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b", 1), (None, "n", 2), (2, "a", 3), (2, None, 4)], "doc_id long, text string, part long")
    tokenfile.write_token_files(docs, f"{tmp_path}/t", spec("byte_bpe_50k.json"))
    rows = sorted(tokenfile.with_starts(tokenfile.read_token_files(spark, f"{tmp_path}/t")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (2, 2, 1), (2, 3, 2), (2, 5, 2)]
    tokenfile.write_token_files(docs.limit(0), f"{tmp_path}/none", spec("byte_bpe_50k.json"))
    assert tokenfile.with_starts(tokenfile.read_token_files(spark, f"{tmp_path}/none")).collect() == []


def test_ids_text(spark, documents, ranks, library):
    row = bpe.encode(documents(["hello there"]), ranks).select(bpe.ids_text(bpe.F.col("ids")).alias("t")).first()
    assert row.t == " ".join(map(str, library.encode_ordinary("hello there")))
    assert hashlib.sha256(b"").hexdigest() == bpe.encode(documents([None]), ranks).select(bpe.F.sha2(bpe.ids_text(bpe.F.col("ids")), 256).alias("t")).first().t

"""Files against the tokenizers library and against zstandard's own reading of the frames."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faintline.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(2)
    bits = ["Hello", "it's", "WE'LL", "é", "Éa", "ß", "1²", "3.14", "...", "’", "😀", "İ", "ΣΑΣ", "é", "<|endoftext|>", "<", "|", "\x85", " ", "\n", "word", "x" * 40, "naïve", "中文", "\x1c", "'", "'S", "ª½", "_a_", "­", "ſ", "Ω", "€5"]
    return [None, "", " ", *[rnd.choice(["", " "]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(1500)], "long words and text " * 60000]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), tokens.Encoder(PATH, 2)
    assert e.fast
    for x in texts():
        assert np.frombuffer(e(x), "<u4").tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x
    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert not other.fast and len(other("Hello there")) == 12


@pytest.mark.parametrize("width", [2, 4])
def test_file(width, monkeypatch):
    monkeypatch.setattr(tokens, "_FRAME", 1000)
    rnd = random.Random(3)
    docs = [(None, [1, 2]), *[(i * 3, [rnd.randrange(60000) for _ in range(rnd.choice([1, 5, 3000]))]) for i in range(200)]]
    sink = io.BytesIO()
    w = tokens.Writer(sink, width)
    for d, ids in docs:
        w.add(d, np.array(ids, "<u4").tobytes())
    w.close()
    data = sink.getvalue()
    r = tokens.Reader(pa.PythonFile(io.BytesIO(data), "r"))
    assert [(int(i) if h else None) for i, h in zip(r.ids, r.has, strict=True)] == [d for d, _ in docs]
    assert r.tokens(7).tolist() == docs[7][1] and r.frames_read <= 8
    assert all(r.tokens(i).tolist() == ids for i, (_, ids) in enumerate(docs))
    whole = b"".join(np.array(ids, f"<u{width}").tobytes() for _, ids in docs)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == whole
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(Exception):
        tokens.Reader(pa.PythonFile(io.BytesIO(bytes(broken)), "r")).tokens(0)


def test_table(spark, tmp_path):
    data = [(i * 7 % 1009, t) for i, t in enumerate(texts())] + [(5, "again"), (None, "no id")]
    path = f"file://{tmp_path}/t"
    tokens.write(spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, start int"), path, PATH, 2)
    got = tokens.read(spark, path).collect()
    e, at, want = tokens.Encoder(PATH, 2), 0, []
    for d, t in sorted(data, key=lambda x: (-1 if x[0] is None else x[0], x[1] is not None, (x[1] or "").encode())):
        ids = e(t)
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    some = tokens.read(spark, path, wanted=[5, 14, 99999], with_ids=True).collect()
    assert {r.doc_id for r in some} == {5, 14} and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in some)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert tokens.read(spark, path).collect() == []

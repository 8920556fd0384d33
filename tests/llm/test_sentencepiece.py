"""SentencePiece codec: parity with the sentencepiece library, with the tokenizers library on whole texts, and round trips."""

import random
import struct

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import sentencepiece_codec as sc
from tessella.llm import tokens

PATH = tokens.vocabulary("piece_bpe_32k.model")
C = sc.codec(PATH)
TEXTS = ["", " ", "  two  spaces ", "Hello, world!", "a\nb\n\n c\td", "<s>x</s><unk><0x0A>", "▁x ▁", "é𝄞中文 ñ", "x" * 300, "Über die Brücke. Élève?! (1999) 3.14%", *(" ".join(random.Random(i).choices(["ntbl", "The", "eré,", "so.", "(a)", "1a2", "a's", "\n"], k=25)) for i in range(20))]


def test_parity():
    assert C.cuts
    assert C.parity(PATH, TEXTS) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab T.,!\n\té▁中<s>0'", max_size=40))
def test_round_trip_and_whole_text_encoding(t):
    ((_, ids, at),) = C.encode(pa.array([t]))
    assert ids.tolist() == (C.whole.encode(t, add_special_tokens=False).ids if t else [])
    got = C.text(*C.decode(ids, at))[0].as_py()
    assert got == t.replace("▁", " ")


def test_frame(spark):
    rows = [(None if i == 3 else i, t, 0) for i, t in enumerate([*TEXTS, None, "w " * 60_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = sc.encode(df)
    got = {r.doc_id: r for r in enc.collect()}
    assert len(got) == len(rows) and all(r.n_tokens * 4 == len(r.ids) for r in got.values())
    assert all(r.round_trip for i, r in got.items() if i is None or sc.MARK not in (rows[i][1] or ""))
    back = {r.doc_id: r.text for r in sc.decode(enc).collect()}
    assert all(back[i] == (t or "").replace(sc.MARK, " ") for i, t, _ in rows)
    assert sc.encode(df.limit(0)).collect() == []


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -2.0, 1), ("▁the", -3.0, 1), ("a", -4.0, 1), ("b", -4.2, 1), ("ab", -5.0, 1), ("▁a", -4.5, 1), ("ba", -5.1, 1), ("t", -6.0, 1), ("h", -6.0, 1), ("e", -6.0, 1)]
    data = b"".join(message([(1, message([(1, p.encode()), (2, s), (3, t)]))]) for p, s, t in pieces)
    data += message([(2, message([(3, 1), (35, 1), (40, 0), (41, 1), (42, 2)])), (3, message([(1, b"identity"), (3, 1), (4, 0), (5, 1)]))])
    path = f"{tmp_path}/u.model"
    with open(path, "wb") as f:
        f.write(data)
    c = sc.Codec(path)
    assert c.model.unigram and c.model.byte_fallback
    rng = random.Random(6)
    texts = ["".join(rng.choices("abthe z", k=rng.randrange(1, 20))).strip() or "a" for _ in range(200)]
    assert c.parity(path, texts) == []


def test_ids_of_control_pieces_decode_to_nothing():
    assert C.text(*C.decode(np.array([1, 2]), np.array([0, 2])))[0].as_py() == ""


def test_parity_over_all_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert max(map(len, texts)) > 10_000
    assert C.parity(PATH, texts) == []

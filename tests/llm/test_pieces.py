"""SentencePiece encoding against the library itself."""

import hashlib
import random

import public_tokenizers as P

from tessera.llm.common import table
from tessera.llm.pieces import ChunkTable, PieceModel, piece_decode, piece_encode
from tessera.llm.queries import QUERIES

from .helpers import frame, odd_rows

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_library(spark):
    sp = library()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op12_sentence_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_texts():
    sp, model, r = library(), PieceModel(MODEL), random.Random(5)
    texts = ["".join(r.choice("abcdehlotn ’é中文  ▁\n\t\x00\x85　=*-#😀") for _ in range(r.randint(0, 120))) for _ in range(1500)]
    texts += ["", " ", "  ", " " * 70, "a" * 3000, "=" * 999, " the" * 500, "<s> </s> <unk> <0x0A>", "▁x", "x▁", "�", "internationalization " * 40, "ſﬁ ﷺ é"]
    table = ChunkTable(model)
    for part in (texts[:700], texts, texts[::-1]):  # new chunks, and chunks met before
        coded, cuts = table.encode(part)
        for t, a, b in zip(part, cuts, cuts[1:]):
            ids = sp.encode(t)
            assert coded[a:b].tolist() == ids, t
            assert model.decode(ids) == sp.decode(ids), t
            assert [i for n in table.names(t) for i in model.segment("▁" + n)] == ids, t


def test_whole_text_as_chunk():
    """A model whose pieces cross markers takes a text as one chunk."""
    sp, model = library(), PieceModel(MODEL)
    model.whole, model.pattern = True, "(?s).+"
    texts = ["a b  c\nd", "", " x", "the same the same " * 20]
    coded, cuts = ChunkTable(model).encode(texts)
    assert [coded[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [sp.encode(t) for t in texts]


def test_decoding_any_ids():
    sp, model, r = library(), PieceModel(MODEL), random.Random(6)
    for _ in range(600):
        ids = [r.choice((r.randrange(3, 260), r.randrange(260), r.randrange(32000))) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == sp.decode(ids), ids


def test_rows_and_blocks(spark):
    sp = library()
    df = frame(spark, odd_rows())
    want = sorted((str(i), sp.encode(t or "")) for i, t in odd_rows())
    for chars in (1, 500, 10**6):  # one text a block, a few, all
        coded = piece_encode(df, MODEL, block_chars=chars)
        assert sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect()) == want
    back = piece_decode(coded, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(i), t or "") for i, t in odd_rows())
    assert piece_encode(df.limit(0), MODEL, decoded=True).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert sorted(str(r) for r in piece_encode(empty, MODEL, decoded=True).collect()) == sorted(f"Row(doc_id={i}, n_tokens=0, ids=[], decoded='')" for i in (1, 2, None))
    ids = spark.createDataFrame([(1, None), (2, []), (3, [None, 259])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in piece_decode(ids, MODEL).orderBy("doc_id").collect()] == ["", "", sp.decode([259])]

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quadrille.llm.pieces import DEFAULT_MODEL, PieceModel, decode_pieces, encode_pieces
from tests.llm.conftest import ODD


def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


def test_ids_equal_the_library_and_decode_to_the_text():
    rng, sp, model = random.Random(1), library(), PieceModel(PieceModel.load())
    texts = [None, "", "a", " ", "   a", "a\nb\n\n c", "\x00x", "日本語 テスト", "😀 é", "▁x", "x" * 200, "ab" * 100 + " " + "the" * 40, "     " * 9]
    texts += [t for _, t in ODD] + ["".join(rng.choice("ab  the\nñ日_=-.") for _ in range(rng.randrange(120))) for _ in range(200)]
    for _ in range(2):  # the second time from memory
        ids = model.encode(pa.array(texts))
        assert ids.to_pylist() == [sp.encode(t or "") for t in texts]
    assert model.decode(ids).to_pylist() == [(t or "").replace("▁", " ") for t in texts]
    assert model.decode(pa.array([[0, 1, 300], None, [255]], pa.list_(pa.int32()))).to_pylist()[1:] == ["", "�"]


def of_pieces(rng, n):
    """Texts of real pieces, code with CRLF, tabs, runs of spaces, repeated stems of eight bytes."""
    sp = library()
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, sp.get_piece_size())]
    stems = [p for p in pieces if len(p.encode()) in (8, 9)]
    code = ["if (a) {\r\n", "\t", "\t\t", "}\r\n", "  ", "    ", ";\r", "\n", "x = y;", "\0", "\x0b"]
    for k in range(n):
        size = range(rng.randrange(1, 25))
        if k % 4 == 0:
            yield "".join(rng.choice(pieces) for _ in size)
        elif k % 4 == 1:
            yield " ".join(rng.choice(stems) + rng.choice(["", "s", "es", "ing", rng.choice(pieces)]) for _ in size)
        elif k % 4 == 2:
            yield "".join(rng.choice([*code, rng.choice(pieces)]) for _ in size)
        else:
            yield "".join(rng.choice([" ", "     ", "a", "the", " of", "日本", "é", "😀", rng.choice(pieces)]) for _ in size)


def test_a_batch_of_real_pieces():
    sp, model = library(), PieceModel(PieceModel.load())
    texts = ["an article of articles", "a;\r\nb", *of_pieces(random.Random(5), 20_000)]
    want = [sp.encode(t) for t in texts]
    assert model.encode(pa.array(texts)).to_pylist() == want
    for t, ids in list(zip(texts, want))[:300]:  # whatever else is in the batch
        model.memory = None
        assert model.encode(pa.array([t])).to_pylist() == [ids]


def test_suffixes_are_sorted_by_their_bytes():
    model, rng = PieceModel(PieceModel.load()), random.Random(6)
    tokens = list(dict.fromkeys(rng.choice(["abcdefgh", "abcdefgha", "abcdefghabcdefgh", "aaaaaaaa", "aaaaaaaaa"]) + "a" * rng.randrange(9) for _ in range(60)))
    text = "".join(tokens).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    eight = np.array([int.from_bytes(text[i : min(i + 8, e)].ljust(8, b"\0"), "big") for i, e in enumerate(ends)], np.uint64)
    rank = model._ranked(eight, np.arange(len(text)), ends)
    deep = [text[i : min(i + 8 * model.deepest, e)] for i, e in enumerate(ends)]
    order = np.argsort(rank, kind="stable")
    assert all(deep[a] <= deep[b] for a, b in zip(order, order[1:]))


def test_models_that_would_be_encoded_otherwise_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb2

    for change in ("kind", "fallback", "spaces"):
        proto = pb2.ModelProto()
        proto.ParseFromString(PieceModel.load())
        if change == "kind":
            proto.trainer_spec.model_type = pb2.TrainerSpec.UNIGRAM
        elif change == "fallback":
            proto.trainer_spec.byte_fallback = False
        else:
            proto.normalizer_spec.remove_extra_whitespaces = True
        with pytest.raises(ValueError):
            PieceModel(proto.SerializeToString())


def test_whole_documents(spark, documents):
    sp, texts = library(), dict(documents)
    rows = encode_pieces(spark.createDataFrame(documents, "doc_id long, text string")).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.token_ids) and r.token_ids == sp.encode(texts[r.doc_id] or "")


def test_odd_rows_and_back(odd):
    ids = encode_pieces(odd, keep=("fp",))
    assert ids.columns == ["doc_id", "fp", "n_tokens", "token_ids", "round_trip"]
    with pytest.raises(ValueError):
        encode_pieces(odd.withColumnRenamed("fp", "n_tokens"), keep=("n_tokens",))
    assert decode_pieces(ids, out_col="fp").columns == ["doc_id", "n_tokens", "token_ids", "round_trip", "fp"]
    back = decode_pieces(ids)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in ODD)
    assert encode_pieces(odd.limit(0)).count() == 0

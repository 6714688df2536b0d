"""The SentencePiece codec against the library."""

import hashlib
import random

import numpy as np
import pytest

from causeway.llm import piece_codec

sentencepiece = pytest.importorskip("sentencepiece")
ALPHABET = [*"abcdeETth  \n\t.,'1234  ▁▁éüßﬁ①ｱ한漢😀́​ \0�<s>㍿½", "  ", "    ", "the", "ing", " of ", "<s>", "</s>", "<unk>", "<0x41>", "　"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def changed(path, rule=None, extra=None, dummy=None, no_bytes=False):
    """The model with other rules of normalization, or without byte pieces."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    spec = format_.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    if rule:
        rules = format_.NormalizerSpec()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        spec.normalizer_spec.precompiled_charsmap = rules.precompiled_charsmap
    if extra is not None:
        spec.normalizer_spec.remove_extra_whitespaces = extra
    if dummy is not None:
        spec.normalizer_spec.add_dummy_prefix = dummy
    if no_bytes:
        spec.trainer_spec.byte_fallback = False
        for p in spec.pieces:
            if p.type == piece_codec.BYTE:
                p.type = piece_codec.NORMAL
    return spec.SerializeToString()


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(n)] + [" " * k for k in range(40)] + ["", "a" * 5000, " " * 3000 + "x", "ab" * 900, "\n" * 70]


def test_texts_together(path, monkeypatch):
    """Parts that are encoded at once, with small caches and batches too, give what each text gives by itself."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    given = texts(2000, 5)
    for cache, together in ((400_000, 1 << 20), (50, 300)):
        monkeypatch.setattr(piece_codec, "CACHE_PARTS", cache)
        monkeypatch.setattr(piece_codec, "TOGETHER", together)
        code = piece_codec.PieceEncoder(open(path, "rb").read())
        assert [ids.tolist() for ids, _ in code.encode_all(given)] == library.encode(given)


@pytest.mark.parametrize("change", [{}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc_cf", "extra": True}, {"extra": True}, {"dummy": False}, {"no_bytes": True}], ids=str)
def test_ids_spans_and_text(path, change):
    model = changed(path, **change)
    library, code = sentencepiece.SentencePieceProcessor(model_proto=model), piece_codec.PieceEncoder(model)
    for text in texts(1500, 3):
        ids, spans = code.encode(text)
        want = library.encode(text, out_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert spans.tolist() == [[p.begin, p.end] for p in want], text
        assert code.tables.decode(ids) == library.decode(ids.tolist()), text


def test_decode_of_any_ids(path):
    library, code = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.encoder(path)
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(259), r.randrange(131, 259), 28705]) for _ in range(r.randrange(12))]
        assert code.tables.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_spans_lead_back_to_the_text(path):
    code, text = piece_codec.PieceEncoder(changed(path, rule="nmt_nfkc")), "ﬁne ① ㍿ naïve　x"
    ids, spans = code.encode(text)
    raw = text.encode()
    assert spans[0, 0] == 0 and spans[-1, 1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
    assert "".join(raw[a:b].decode() for a, b in spans) == text
    assert code.tables.decode(ids) == "fine 1 株式会社 naïve x"


def test_longest_source_string(path):
    """Of several source strings that begin at one place, the longest is replaced."""
    compiled = piece_codec.PieceTables(changed(path, rule="nmt_nfkc")).map
    size, at = compiled.longest("ｶﾞx".encode(), 0)
    assert size == len("ｶﾞ".encode()) and compiled.replacement(at).decode() == "ガ"
    size, at = compiled.longest("ｶx".encode(), 0)
    assert size == len("ｶ".encode()) and compiled.replacement(at).decode() == "カ"
    assert compiled.longest(b"plain", 0) is None and compiled.starts("ｶ") and not compiled.starts("漢")
    assert piece_codec.CharacterMap(b"").longest(b"x", 0) is None


def test_full_caches_change_nothing(path, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_PARTS", 3)
    library, code = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceEncoder(open(path, "rb").read())
    for text in texts(100, 9):
        assert code.encode(text)[0].tolist() == library.encode(text)


def test_other_models_are_refused(path):
    from sentencepiece import sentencepiece_model_pb2 as format_

    for change in ("type", "piece"):
        spec = format_.ModelProto()
        spec.ParseFromString(changed(path))
        if change == "type":
            spec.trainer_spec.model_type = 1
        else:
            spec.pieces[500].type = piece_codec.USER_DEFINED
        with pytest.raises(ValueError):
            piece_codec.PieceTables(spec.SerializeToString())


def test_table(spark, path):
    """Nulls, empty and very long texts, repeated rows, null ids, clashing names, an empty table."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, None), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n"), (None, "naïve 😀"), (5, "word, " * 40_000), (6, "x" * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, ids string, begins int")
    out = sorted((tuple(r) for r in piece_codec.encode(docs, path, pieces=True).drop("spans_sha256").collect()), key=str)
    want = []
    for i, text in rows:
        ids, proto = library.encode(text or ""), library.encode(text or "", out_type="proto").pieces
        decoded = library.decode(ids)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        want.append((i, len(ids), *digest, ids, [p.begin for p in proto], [p.end for p in proto], decoded))
    assert out == sorted(want, key=str)
    assert piece_codec.encode(docs.limit(0), path).collect() == []

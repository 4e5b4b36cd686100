import public_tokenizers
import pytest
import sentencepiece

from bioquery.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "Hello  world\n\tx", "é 日本 🜁\0z", " lead and trail ", "a" * 3000, "Ａ ①x ﬁ ガ ｶﾞ é", "x\r\ny"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("text", [t for t in TEXTS if "\0" not in t])
def test_normaliser_is_that_of_the_library(rule, text):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    out, align = sp.Normaliser(sp.ModelSpec(library.serialized_model_proto()))(text.encode())
    want, offsets = library.normalize(text, with_offsets=True)
    assert out.decode() == want
    chars, at = [], 0
    for c in want:
        chars.append(len(text.encode()[: align[at]].decode()))
        at += len(c.encode())
    assert chars == offsets[: len(want)]


@pytest.mark.parametrize("text", TEXTS)
def test_spans_tile_the_text(text):
    encoder = sp.Encoder(PATH)
    ids = encoder.encode([text])[0]
    starts, ends = encoder.spans(text, ids)
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
    assert ids == encoder.library.encode(text, add_eos=True)
    assert encoder.library.decode(ids) == text


def test_table(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (None, "a b", 2)], "doc_id long, text string, ids int")
    rows = sp.encode_documents(df, PATH).collect()
    assert [(r.doc_id, r.n_tokens, r.covered) for r in rows][0] == (1, 1, True)
    assert rows[1] == rows[2]
    assert sp.encode_documents(df, PATH, digests=False).collect()[1].decoded == "a b"
    assert sp.encode_documents(df.limit(0), PATH).count() == 0

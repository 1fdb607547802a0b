"""Steps of the pipeline's stages on their own."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_pieces_are_decoded(spark):
    """The last stage decodes what it encoded, as the library does; a null text gives an empty one."""
    import public_tokenizers
    import sentencepiece

    texts = {1: "plain words  and blanks", 2: "né 漢字 \U0001f600\nnext line", 3: None, 4: "", 5: "a▁b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("decoded", F.lit("mine"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (list(r.ids), r.decoded) for r in corpus_pipeline.sentence_pieces(spark, docs, "").collect()}
    assert got == {i: (ids := [*model.encode(t or ""), model.eos_id()], model.decode(ids)) for i, t in texts.items()}

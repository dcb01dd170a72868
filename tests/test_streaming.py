from counterfact.operators import environments as envs
from counterfact.operators.dictionary import TermDictionary, single_hits
from counterfact.sources import corpus

TERMS = TermDictionary([("he", "she")])


def test_row_wise_operators_accept_a_stream(spark, lines_of, tmp_path):
    lines = lines_of(["he is", " ", "so she and he", "the she"])
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    hits = single_hits(envs.env_assign(corpus.clean_lines(stream), TERMS, 0, 0.5), TERMS)
    query = (
        hits.select("doc_id", "env", "target")
        .writeStream.format("memory")
        .queryName("hits")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    batch = single_hits(envs.env_assign(corpus.clean_lines(lines), TERMS, 0, 0.5), TERMS)
    want = {tuple(r) for r in batch.select("doc_id", "env", "target").collect()}
    assert {tuple(r) for r in spark.table("hits").collect()} == want and len(want) == 2

"""Files of pairs hold every text some four times: they are written compressed."""
import glob

from quillmark.plans.queries import chain_pairs
from quillmark.sources import corpora as K


def test_pair_files_are_compressed_and_whole(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven é\n\"quoted\" "
    rows = [(i, f"a{i % 2}", text * (40 + i), "en") for i in range(12)]
    c = spark.createDataFrame(rows, "doc_id long, author string, text string, lang string")
    pairs = chain_pairs(c.select("doc_id", "author"))
    pp, pt = str(tmp_path / "pairs"), str(tmp_path / "truth")
    K.write_jsonl_pairs(pairs, c, pp, pt)
    assert glob.glob(f"{pp}/*.json.gz") and not glob.glob(f"{pp}/*.json")  # plain before
    got = sorted((r["id"], r["pos"], r["author"], r["text"]) for r in K.read_jsonl_pairs(spark, pp, pt).collect())
    want = sorted((f"{r['a']}-{r['b']}", at, f"a{d % 2}", rows[d][2]) for r in pairs.collect() for at, d in enumerate((r["a"], r["b"])))
    assert got == want

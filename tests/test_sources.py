"""Format readers on hand-made fixtures (written with Spark into a fresh folder)."""
import pathlib
import tempfile

from pyspark.sql import functions as F

from quillmark.sources import corpora as K


def test_tagged_records_roundtrip(spark):
    nl = chr(10)
    c = spark.createDataFrame([(1, "a1", "line one" + nl + "line two"), (2, "a2", "x")],
                              "doc_id long, author string, text string")
    p = tempfile.mkdtemp(prefix="quill-test-", dir="/tmp") + "/t"
    K.write_tagged(c, p)
    got = {(r["text_id"], r["author"], r["text"]) for r in K.read_tagged(spark, p).collect()}
    assert got == {("1", "a1", "line one" + nl + "line two"), ("2", "a2", "x")}


def test_message_bodies_cut_at_markers(spark):
    body = "one two three four five six seven eight nine ten eleven -----Original Message----- old text"
    m = spark.createDataFrame([(i, "me", body) for i in range(5)], "msg_id long, author string, body string")
    out = K.message_body_corpus(m, 10, 5).collect()
    assert len(out) == 5 and all("Original" not in r["text"] for r in out)


def test_merge_requests_first_request_wins(spark):
    r0 = spark.createDataFrame([("1", "t", "a", "X")] * 1, "id string, title string, abstract string, author string")
    r1 = spark.createDataFrame([("1", "t2", "b", "X"), ("2", "t", "c", "X")], "id string, title string, abstract string, author string")
    out = {r["id"]: r["req_no"] for r in K.merge_requests([r0, r1], min_docs=1).collect()}
    assert out == {"1": 0, "2": 1}


def test_a_file_per_document_is_written_and_listed_by_tasks(spark):
    rows = [(i, f"a{i % 3}", f"text {i}") for i in range(300)] + [(7, "x/y%z", "odd"), (1, "_u", ""), (None, "a1", "no id"), (5, None, "none")]
    c = spark.createDataFrame(rows, "doc_id long, author string, text string")
    p = tempfile.mkdtemp(prefix="quill-test-", dir="/tmp")
    K.write_dir_corpus(c, p + "/d")
    # a folder per author and a file in it per document: no folder per document, no commit by the driver
    assert len([f for f in pathlib.Path(p + "/d").iterdir()]) == 6 and not [f for f in pathlib.Path(p + "/d").rglob("doc_id=*") if f.is_dir()]
    nothing = "__HIVE_DEFAULT_PARTITION__"
    assert {tuple(r) for r in K.read_dir_corpus(spark, p + "/d").collect()} == {(a or nothing, i, t) for i, a, t in rows}
    K.write_filename_corpus(c.where("author like 'a%' and doc_id is not null"), p + "/n")
    got = [tuple(r) for r in K.read_filename_corpus(spark, "file://" + p + "/n").collect()]
    assert sorted(got) == sorted((a, str(i), t) for i, a, t in rows[:300])


def test_author_folders_of_other_origin(spark):
    p = pathlib.Path(tempfile.mkdtemp(prefix="quill-test-", dir="/tmp"))
    for name, text in (("alice/12.txt", "one"), ("alice/known.txt", "two\n"), ("unknown1/3.txt", "no"), ("bob/doc_id=4/part-0.txt", "four\n\n"),
                       ("bob/truth.txt", "no"), ("bob/_SUCCESS", ""), ("contents.json", "no"), (".x/1.txt", "no")):
        (p / name).parent.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(text)
    got = {tuple(r) for r in K.read_dir_corpus(spark, str(p)).collect()}
    assert got == {("alice", 12, "one"), ("alice", None, "two"), ("bob", 4, "four\n")}
    (p / "Dante_de_vulgari.txt").write_text("text")
    assert ("Dante", "de_vulgari", "text") in {tuple(r) for r in K.read_filename_corpus(spark, str(p)).collect()}


def test_pair_authors_are_chosen_without_the_texts(spark):
    p = pathlib.Path(tempfile.mkdtemp(prefix="quill-test-", dir="/tmp"))
    long = " ".join(["word"] * 12)
    (p / "pairs").write_text("\n".join(f'{{"id": "{i}", "pair": ["{long} a{i}", "{long if i else "short"} b{i}"]}}' for i in (0, 1, 1, 2)))
    (p / "truth").write_text("\n".join(f'{{"id": "{i}", "authors": ["x", "y{i}"]}}' for i in (0, 1, 1, 2)))
    d = K.read_jsonl_pairs(spark, str(p / "pairs"), str(p / "truth"))
    got = sorted((r["id"], r["pos"], r["author"], r["text"][-2:]) for r in d.collect())
    assert got == [("0", 0, "x", "a0")] + [("1", 0, "x", "a1")] * 4 + [("1", 1, "y1", "b1")] * 4 + [("2", 0, "x", "a2")]
    lines = d._jdf.queryExecution().optimizedPlan().toString().split("\n")
    semi = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    assert not any("text#" in line for line in lines[semi:semi + 3])

"""Published tables, collections with replacing and deleting, commits of manifests, and facts of files."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import collections as C
from lodestone.operators import facts as K
from lodestone.operators import manage as M
from lodestone.sources import published
from lodestone.sources.collection import Collection, Meta, Refused, check_rows, collection_name, described

META = Meta("m", "1", 2, "cosine", "r" * 20)
ROW = "id string, doc_id string, doc_version string, text string, vector array<double>, roles array<string>, section array<string>, pages array<string>"


def rows_of(spark, docs, version="1", n=3):
    return spark.createDataFrame([(f"{d}-{k}-{version}", d, version, "t", [1.0, 2.0], ["a"], ["h"] if k else [], [str(k + 1)]) for d in docs for k in range(n)], ROW)


def test_published(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert published.current(spark, root) is None and published.versions(spark, root) == []
    first = published.publish(spark.range(3), root)
    published.publish(spark.range(5), root)
    # a write that fails half way leaves no version that counts
    with pytest.raises(Exception, match="half way"):
        published.publish(spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).alias("id")), root)
    assert published.current(spark, root).count() == 5 and len(published.versions(spark, root)) == 2
    assert published.publish(spark.range(7), root).endswith("00000004") and published.current(spark, root).count() == 7
    gone = published.retire(spark, root, keep=2)
    assert first in gone and len(gone) == 2 and [p[-1] for p in published.versions(spark, root)] == ["2", "4"]


def test_collection(spark, tmp_path):
    root = f"file://{tmp_path}"
    name = collection_name("recipe0123456789abc", "artifact-0123456789")
    assert name == "recipe0123456789-artifact-012"
    c = Collection(spark, root, name, buckets=8)
    with pytest.raises(FileNotFoundError):
        c.read()
    docs = [f"d{k}" for k in range(30)] + [None]
    c.write_all(rows_of(spark, docs), META)
    assert c.meta() == META and c.read().count() == 93 and c.documents().count() == 31
    before = {r.bucket: r.folder for r in c.state().collect()}
    c.change(fresh=rows_of(spark, ["d1", "d99"], "2", 2), gone=spark.createDataFrame([("d3",), (None,), ("none such",)], "doc_id string"))
    got = {r.doc_id: (r.n, r.v) for r in c.read().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("doc_version").alias("v")).collect()}
    assert got == {d: (3, "1") for d in docs if d not in ("d1", "d3", None)} | {"d1": (2, "2"), "d99": (2, "2")}
    after = {r.bucket: r.folder for r in c.state().collect()}
    touched = {r[0] for r in spark.createDataFrame([("d1",), ("d99",), ("d3",), (None,), ("none such",)], "doc_id string").select(c._bucket()).collect()}
    assert len(touched) < 8 and all((after[b] == before[b]) == (b not in touched) for b in range(8))
    # a change that fails leaves the rows as they are, and another handle sees the same
    with pytest.raises(Refused):
        c.change(fresh=rows_of(spark, ["d5"], "3").withColumn("vector", F.array(F.lit(1.0))))
    assert Collection(spark, root, name, buckets=99).read().count() == sum(n for n, _ in got.values())
    assert c.retire(keep=1) == 0 and c.read().count() == sum(n for n, _ in got.values())  # untouched buckets still use the first files
    c.write_all(rows_of(spark, []), META)
    assert c.read().count() == 0 and c.read().columns == [x.split()[0] for x in ROW.split(", ")] and c.retire(keep=1) == 3
    c.change(fresh=rows_of(spark, ["x"]))
    assert c.read().count() == 3


def test_refused_rows(spark):
    good = rows_of(spark, ["a"])
    check_rows(good, 2)
    for bad, said in (
        (good.withColumn("vector", F.array(F.lit(1), F.lit(2))), "float or double"), (good.withColumn("vector", F.lit(None).cast("array<double>")), "no vector"), (good.withColumn("vector", F.array(F.lit(1.0), F.lit(float("nan")))), "not finite"),
        (good.withColumn("vector", F.array(F.lit(1.0), F.lit(None).cast("double"))), "not finite"), (good.withColumn("id", F.lit(None).cast("string")), "no id"), (good.drop("roles"), "lack roles"),
    ):
        with pytest.raises(Refused, match=said):
            check_rows(bad, 2)
    d = described(good, META).first()
    assert (d.n_rows, d.documents, d.sections, d.max_page, d.dims, d.model) == (3, 1, 2, 3, 2, "m@1")
    assert described(good.drop("section", "pages").limit(0), META).first().max_page == 0


DOCS = "doc_id string, content_hash string, chunk_set string, category string, reason string, metadata map<string,string>, version string, error string, label string, folder string"


def sync(spark, *rows):
    return spark.createDataFrame([(d, h, "p", "new", "rule", m, "v", e, label, "src") for d, h, m, e, label in rows], DOCS)


def test_commit(spark, tmp_path):
    root, built = f"file://{tmp_path}/manifest", []
    roles = M.roles_and_reason(F.col("label"), F.col("folder"), (), (), ("public",))

    def build(after):
        built.append(after.count())
        return f"index-{len(built)}"

    status = lambda df: {r.doc_id: r.status for r in df.collect()}
    first = sync(spark, ("a", "1", {"k": "v"}, None, None), ("b", "1", None, None, "staff"), ("c", "1", None, "no text", None))
    assert status(C.commit(spark, root, first, build, roles)) == {"a": "added", "b": "added", "c": "failed"}
    now = {r.doc_id: r for r in C.current_manifest(spark, root).collect()}
    assert set(now) == {"a", "b"} and now["b"].roles == ["staff"] and now["a"].roles == ["public"] and now["a"].collection == "index-1"
    # the category set before stays, new metadata replace old, roles are taken anew, a document not listed goes
    second = sync(spark, ("a", "2", None, None, "admin"), ("c", "1", {"x": "y"}, None, None)).withColumn("category", F.lit("other"))
    assert status(C.commit(spark, root, second, build, roles)) == {"a": "changed", "b": "removed", "c": "added"}
    now = {r.doc_id: r for r in C.current_manifest(spark, root).collect()}
    assert now["a"].category == "new" and now["a"].metadata == {"k": "v"} and now["a"].roles == ["admin"] and now["c"].category == "other"

    def broken(after):
        raise RuntimeError("no space")

    with pytest.raises(RuntimeError):
        C.commit(spark, root, first, broken, roles)
    every = sync(spark, ("a", "3", None, "bad", None))
    assert status(C.commit(spark, root, every, build, roles)) == {"a": "failed", "c": "removed"} and len(built) == 2
    assert {r.doc_id: r.content_hash for r in C.current_manifest(spark, root).collect()} == {"a": "2", "c": "1"}
    assert status(C.commit(spark, root, second, build, roles)) == {"a": "unchanged", "c": "unchanged"}


def test_add_list_preview(spark):
    m = spark.createDataFrame([("a.md", "a.md", "x", "rule", ["p"], "1"), ("b.md", "b.md", "y", "pinned", ["p"], "1")], "doc_id string, name string, category string, reason string, roles array<string>, version string")
    fresh = m.where("doc_id = 'a.md'").withColumn("version", F.lit("2")).unionByName(spark.createDataFrame([("c.md", "c.md", "x", "rule", None, "2"), ("c.md", "c.md", "x", "rule", None, "2")], m.schema))
    got = {r.doc_id: (r.version, r.error) for r in C.added(m, fresh).collect()}
    assert got == {"a.md": ("1", "already in the collection"), "b.md": ("1", None), "c.md": ("2", None)}
    assert {r.doc_id: r.version for r in C.added(m, fresh, replace=True).collect()} == {"a.md": "2", "b.md": "1", "c.md": "2"}
    assert [r.doc_id for r in C.listed(m).collect()] == ["a.md", "b.md"] and [r.doc_id for r in C.listed(m, "y", "B*").collect()] == ["b.md"]
    rule = F.struct(F.when(F.col("doc_id") == "a.md", "z").otherwise("x").alias("category"), F.lit("Rule 1").alias("reason"))
    docs = m.select("doc_id").unionByName(spark.createDataFrame([("n.md",)], "doc_id string"))
    assert {tuple(r) for r in C.sort_preview(m, docs, rule).collect()} == {("a.md", "x", "z", "Rule 1"), ("n.md", None, "x", "Rule 1")}


@pytest.mark.parametrize(
    "html,want",
    [
        (None, {}), ("", {}), ("<p>no head", {}), ("<title> A &amp;\n B </title>", {"Title": "A & B"}), ("<meta name=a content=1><META NAME='A' CONTENT='2'>", {"a": "1"}),
        ('<meta content="x > y" data-name="no" name="k">', {"k": "x > y"}), ("<meta property=og:title content='t'><meta name=title content=m>", {"og:title": "t", "title": "m"}),
        ("<meta name=Title content=m><title>T</title>", {"Title": "T"}), ("<!-- <meta name=a content=b> --><script>'<meta name=c content=d>'</script>", {}), ("<meta name='' property=p content=q><meta name=n content=''>", {"p": "q"}),
    ],
)
def test_html_properties(spark, html, want):
    assert spark.createDataFrame([(html,)], "html string").select(K.html_properties(F.col("html"))).first()[0] == want


def test_route_checks(spark):
    d = spark.createDataFrame([({"Author": "Ann Lee", "author": "second"}, "PDF text", None, "pdf"), (None, None, True, None)], "m map<string,string>, first string, layer boolean, type string")
    m = F.col("m")
    got = d.select(
        K.metadata(m, "AUTHOR", equals="ann lee"), K.properties(m, "author", contains="LEE"), K.metadata(m, "author", pattern="ann*"), K.metadata(m, "none", equals="x"), K.text_layer(F.col("layer")), K.text_layer(F.col("layer"), False),
        K.contains_any(F.col("first"), ["zz", "TEXT"]), K.contains_any(F.col("first"), []), K.file_type(F.col("type"), ["PDF", "docx"]), K.path_like(F.col("first"), "pdf*"),
    )
    assert [list(r) for r in got.collect()] == [[True, True, True, False, False, False, True, False, True, True], [False, False, False, False, True, False, False, False, False, False]]
    with pytest.raises(ValueError, match="one of"):
        K.metadata(m, "a", equals="x", pattern="y")
    labels = spark.createDataFrame([("a/b.html", {"path": "z", "k": "v", "n": None}), ("x.zzz", None)], "doc_id string, c map<string,string>").select(K.source_labels(F.col("doc_id"), F.col("c")))
    assert [r[0] for r in labels.collect()] == [{"k": "v", "path": "a/b.html", "content_type": "text/html"}, {"path": "x.zzz", "content_type": "application/octet-stream"}]


def test_rows_are_made_once_and_refused_ones_leave_nothing(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    rows = rows_of(spark, ["a", "b", "c"])
    Collection(spark, str(tmp_path), "once", buckets=2).write_all(rows.withColumn("id", seen("id")), META)
    assert made.value == rows.count()
    c = Collection(spark, str(tmp_path), "bad", buckets=2)
    with pytest.raises(Refused, match="not finite"):
        c.write_all(rows.withColumn("vector", F.array(F.lit(1.0), F.lit(float("nan")))), META)
    with pytest.raises(FileNotFoundError):
        c.read()
    assert not list((tmp_path / "bad" / "rows").iterdir())

"""Contracts, usages, digests, sources, sinks and column functions."""

import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scalars
from weftline.operators import quality
from weftline.operators.quality import ContractError
from weftline.sources import readers, schemas, shards, sinks
from weftline.streaming import ingest


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_canonical_edges(spark):
    kind = "snapshot_id string, src string, dst string, edge_type string, multiplicity bigint"
    make = lambda *m: spark.createDataFrame([("s", "a", "b", "TYPE", x) for x in m], kind)
    assert [r["multiplicity"] for r in quality.canonical_edges(make(3, 3)).collect()] == [3]
    for bad in ((2, 3), (None,), (0,)):
        with pytest.raises(Exception, match="multiplicit"):
            quality.canonical_edges(make(*bad)).collect()


def test_null_counts_and_conflicts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a bigint, b bigint")
    assert {r["column_name"]: r["nulls"] for r in quality.null_counts(df).collect()} == {"a": 1, "b": 2}
    df = spark.createDataFrame([("k", 1), ("k", None), ("j", 2), ("j", 2)], "k string, v bigint")
    assert [r["k"] for r in quality.conflicts(df, ["k"], ["v"]).collect()] == ["k"]


def test_checked_join(spark):
    left, right = spark.createDataFrame([(1,)], "k bigint"), spark.createDataFrame([(1, 1), (1, 2)], "k bigint, v bigint")
    with pytest.raises(quality.ContractError):
        quality.checked_join(left, right, ["k"])
    assert quality.checked_join(right, left, ["k"]).count() == 2


def test_usage_classes(spark):
    nodes = spark.createDataFrame([(1, "local", "Fixture"), (2, "foreign", "Other")], "node_id bigint, name string, module string")
    usages = spark.createDataFrame([("local", "Fixture"), ("foreign", "Fixture"), ("Missing", "Fixture"), (None, "Fixture")], "parent_decl string, module string")
    got = sorted(r["usage_class"] for r in quality.classify_usages(usages, nodes).collect())
    assert got == ["attributed", "mismatched", "unparented", "unresolved"]


def test_complexity_aliases(spark):
    kind = "name string, module string, v bigint"
    raw = spark.createDataFrame([("g", "M1", 7), ("g", "M2", 7), ("o", "M2", 1)], kind)
    nodes = spark.createDataFrame([("g", "M2"), ("o", "M2")], "name string, module string")
    chosen, aliases = quality.select_complexity(raw, nodes, ["v"])
    assert sorted((r["name"], r["module"]) for r in chosen.collect()) == [("g", "M2"), ("o", "M2")]
    assert [r["module"] for r in aliases.collect()] == ["M1"]
    with pytest.raises(quality.ContractError):
        quality.select_complexity(spark.createDataFrame([("g", "M1", 7), ("g", "M2", 8)], kind), nodes, ["v"])
    with pytest.raises(quality.ContractError):
        quality.select_complexity(raw.where("name = 'g'"), nodes, ["v"])


def test_digest_ignores_order_and_parts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k bigint, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "k bigint, v string").repartition(3)
    assert quality.digest(a) == quality.digest(b) != quality.digest(a.distinct())
    merged = quality.merge_states(quality.digest_state(a.where("k = 1")), quality.digest_state(a.where("k = 2")))
    assert quality.state_digest(merged) == quality.digest(a)
    assert quality.digest(a.where("k > 5")) == quality.digest(b.where("k > 5"))


def test_dense_ids_and_shards(spark):
    names = spark.createDataFrame([(f"n{k % 70:03d}",) for k in range(200)], "name string")
    got = sorted((r["node_id"], r["name"]) for r in quality.dense_ids(names).collect())
    assert got == [(k, f"n{k:03d}") for k in range(70)]
    plan = quality.shard_plan(names.withColumnRenamed("name", "module"))
    assert {r["shard"]: r["n"] for r in plan.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 25, 1: 25, 2: 20}


def test_records_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("node", "a", Decimal(18446744073709551615)), ("edge", None, Decimal(2))], "record string, name string, multiplicity decimal(20,0)")
    sinks.json_lines(raw, str(tmp_path / "raw"))
    back = readers.records(spark, str(tmp_path / "raw"), schemas.RAW_RECORD)
    assert [r["multiplicity"] for r in readers.of_kind(back, "node").collect()] == [18446744073709551615]
    import zstandard

    (tmp_path / "one.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"record": "node", "name": "z"}\n'))
    assert [r["name"] for r in readers.records(spark, str(tmp_path / "one.jsonl.zst"), schemas.RAW_RECORD).collect()] == ["z"]
    (tmp_path / "bad.json").write_text('{"record": "node"}\nnot json\n')
    with pytest.raises(Exception):
        readers.records(spark, str(tmp_path / "bad.json"), schemas.RAW_RECORD).collect()
    loose = readers.records(spark, str(tmp_path / "bad.json"), schemas.RAW_RECORD, strict=False).cache()
    assert loose.where("_corrupt_record IS NOT NULL").count() == 1
    first = sinks.install(raw, str(tmp_path / "table"))
    assert sinks.install(raw.repartition(2), str(tmp_path / "table")) == first
    with pytest.raises(ValueError):
        sinks.install(raw.limit(1), str(tmp_path / "table"))
    assert json.loads(sinks.document(raw.select("record")))[0] == {"record": "node"}
    assert sinks.manifest({"raw": raw})["tables"]["raw"]["nulls"]["name"] == 1
    sinks.csv(raw, str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv"), raw.schema).count() == 2


def test_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("module_name\tclass_name\tsuper_name\tinterfaces\nm\tA\\tB\t\tI,J\n")
    r = readers.tsv(spark, str(tmp_path / "c.tsv"), schemas.RAW_CLASS).first()
    assert (r["class_name"], r["super_name"], r["interfaces"]) == ("A\\tB", None, "I,J")
    assert spark.createDataFrame([("",), ("7",)], "v string").select(readers.nullable_int("v").alias("v")).collect()[0]["v"] is None


def test_reference_documents(spark):
    key = '{"c":{"m":"Target","n":"target"}}'
    doc = json.dumps({"module": "Fixture", "references": {key: {"usages": [[1, 2, 3, 4, "p"], [1, 2, 3, 4, "p"], [5, 6, 7, 8], [9, 1, 9, 2, "q"]]}, '{"f":1}': {"usages": [[1, 1, 1, 1]]}}})
    rows = readers.reference_documents(spark.createDataFrame([("f", doc)], "path string, text string"), "s").orderBy(F.asc_nulls_first("parent_decl")).collect()
    assert [(r["parent_decl"], r["start_line"]) for r in rows] == [(None, 5), ("p", 1), ("q", 9)]
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([('{"c":{"m":"x"}}',)], "k string").select(readers.constant_identity(F.col("k")).alias("t")).collect()


def test_archive_lines(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "src.zip", "w") as z:
        z.writestr("a/B.java", "one\ntwo\nthree\n")
    wanted = spark.createDataFrame([("src.zip", "a/B.java", 2, 3), ("src.zip", "none", 1, 1)], "archive string, member string, start bigint, end bigint")
    got = {r["member"]: r["excerpt"] for r in readers.archive_lines(spark, str(tmp_path / "src.zip"), wanted).collect()}
    assert got == {"a/B.java": "two\nthree", "none": None}


def test_malformed_records_are_named_by_line(spark, tmp_path):
    """Files that are cut into many splits: the number is that of the line in its file."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good = lambda k: json.dumps({"id": k, "name": "n" * (k % 50)})
    lines = {"a": [good(k) for k in range(3000)], "b": [good(k) for k in range(900)], "c": ["", good(1), " ", "{", good(2)]}
    lines["b"][700] = '{"id": 700, "name"'
    for name, rows in lines.items():
        (tmp_path / f"{name}.json").write_text("\n".join(rows) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r["path"].rsplit("/", 1)[1], r["line"]): r["value"] for r in readers.bad_lines(spark, str(tmp_path), schema).collect()}
        assert got == {("b.json", 701): '{"id": 700, "name"', ("c.json", 4): "{"}
        with pytest.raises(ContractError, match=r"b\.json:701; .*c\.json:4"):
            readers.checked_records(spark, str(tmp_path), schema)
        assert readers.checked_records(spark, str(tmp_path / "a.json"), schema).count() == 3000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_canonical_export_does_not_depend_on_partitions(spark, tmp_path):
    """The bytes of every part and all digests are equal for other partitionings; one changed row changes one part."""
    rows = [(k % 200, f"é{k % 7}\n", None if k % 3 else float(k)) for k in range(500)] + [(1, None, None)] * 3

    def export(name, rows, partitions):
        df = spark.createDataFrame(rows, "b long, a string, c double").repartition(partitions)
        whole = sinks.canonical(df, str(tmp_path / name), rows_per_part=64)
        parts = {}
        for folder in sorted((tmp_path / name / "lines").glob("part=*"), key=lambda p: int(p.name[5:])):
            (file,) = folder.glob("*.txt")
            parts[int(folder.name[5:])] = file.read_bytes()
        told = {r["part"]: (r["n_rows"], r["sha256"]) for r in spark.read.parquet(str(tmp_path / name / "digests")).collect()}
        assert told == {k: (data.count(b"\n"), hashlib.sha256(data).hexdigest()) for k, data in parts.items()}
        return whole, parts

    one, two = export("one", rows, 1), export("two", rows[::-1], 9)
    assert one == two and sum(d.count(b"\n") for d in one[1].values()) == 503 and len(one[1]) == 8
    lines = b"".join(one[1].values()).splitlines()
    assert lines == sorted(lines) and json.loads(lines[0]).keys() == {"a", "b", "c"}
    other = export("other", [*rows[:-1], (1, "zz", 1.0)], 4)
    assert other[0] != one[0]
    assert export("none", [], 2)[1] == {}


def test_shards_are_resumed(spark, tmp_path):
    """A second run writes nothing; damaged, lost and changed shards are written again, and those alone."""
    path = str(tmp_path / "shards")
    make = lambda rows: spark.createDataFrame(rows, "id long, name string, shard int").repartition(5)
    rows = [(k, None if k % 7 == 0 else f"n{k}", k % 4) for k in range(80)] + [(3, "n3", 3)]
    run = lambda rows, plan="v1": sorted((r["shard_key"], r["n_rows"]) for r in shards.write_shards(make(rows), path, "shard", plan).collect())
    held = lambda: sorted(map(str, shards.stored(spark, path, make(rows)).select("id", "name", "shard").collect()))
    assert run(rows) == [("0", 20), ("1", 20), ("2", 20), ("3", 21)]
    want = held()
    assert len(want) == 81 and run(rows[::-1]) == []
    for folder, damage in (("shard=1", lambda f: f.write_bytes(b"no parquet")), ("shard=2", lambda f: f.unlink())):
        for f in (tmp_path / "shards" / "data" / folder).iterdir():
            damage(f) if f.suffix == ".parquet" else f.unlink()
    assert run(rows) == [("1", 20), ("2", 20)] and held() == want and run(rows) == []
    assert run([(0, "other", 0), *rows[1:]]) == [("0", 20)]
    assert run(rows[:40]) == [("0", 10), ("1", 10), ("2", 10), ("3", 10)]
    assert len(run(rows[:40], "v2")) == 4


def test_comma_lists(spark):
    lists = lambda t, *kind: _one(spark, scalars.comma_list(F.col("t"), *kind), t=t)
    assert [lists("a,b"), lists(""), lists("a,")] == [["a", "b"], [], ["a", ""]]
    assert spark.range(1).select(scalars.comma_list(F.lit(None).cast("string"))).first()[0] is None
    assert lists("3,-1", "int") == [3, -1]


def test_whole_texts_inventories_and_batches(spark, tmp_path):
    """Files as rows of path and text, the modules of an inventory, and batches appended to one partitioned table."""
    for name, text in (("a.txt", "one\ntwo\n"), ("b.txt", "")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.texts(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()}
    assert got["a.txt"] == "one\ntwo\n" and not got.get("b.txt")
    (tmp_path / "i.json").write_text('{"version": 1,\n "modules": [{"module": "A", "bytes": 3}, {"module": "B", "bytes": null}]}')
    assert [tuple(r) for r in readers.inventory(spark, str(tmp_path / "i.json")).select("module", "bytes").orderBy("module").collect()] == [("A", 3), ("B", None)]
    out = str(tmp_path / "batches")
    for batch in ([(1, "m"), (2, "n")], [(3, "m")], []):
        sinks.append_batch(spark.createDataFrame(batch, "id int, module string"), out, "module")
    table = spark.read.parquet(out)
    assert sorted((r["id"], r["module"]) for r in table.collect()) == [(1, "m"), (2, "n"), (3, "m")]
    assert [r["id"] for r in table.where("module = 'n'").collect()] == [2]


def test_names_and_paths(spark):
    gen = lambda n: _one(spark, scalars.is_generated(F.col("n")), n=n)
    assert [gen(n) for n in ("Nat.rec", "Nat.recOn", "Nat.add", "_private.M.0.x", "A.injEq", "A._b")] == [True, True, False, True, True, True]
    assert _one(spark, scalars.module_of(F.col("p")), p="Lib/Topic/Basic.lean") == "Lib.Topic.Basic"
    dom = lambda m: _one(spark, scalars.domain_of(F.col("m"), "Lib"), m=m)
    assert [dom("Lib.Topic.Basic"), dom("Extras.X"), dom("Lib")] == ["Topic", "Extras", "Lib"]
    glob = lambda p: _one(spark, scalars.first_glob(F.col("p"), ["Extras/**", "*.md"], "root/"), p=p)
    assert [glob("Extras/a/b.lean"), glob("root/Extras/x"), glob("a.md"), glob("z")] == ["Extras/**", "Extras/**", "*.md", None]


def test_slice_range(spark):
    cut = scalars.slice_range(F.col("t"), *[F.col(c).cast("bigint") for c in ("a", "b", "c", "d")])
    text = "zero\n  one\ntwo rest\nlast"
    get = lambda a, b, c, d: spark.createDataFrame([(text, a, b, c, d)], "t string, a bigint, b bigint, c bigint, d bigint").select(cut.alias("x")).first()["x"]
    assert get(2, 2, 3, 3) == "one\ntwo"
    assert get(2, 2, 2, 5) == "one" and get(2, 2, 2, 99) == "one\n"
    assert get(0, 0, 1, 1) is None and get(1, 0, 9, 1) is None and get(1, None, 1, 1) is None


def test_source_metrics(spark):
    assert _one(spark, scalars.source_tokens(F.col("t")), t="def f' (x1 := 42) é") == 9
    assert _one(spark, scalars.source_lines(F.col("t")), t="a\nb\n") == 3 and _one(spark, scalars.source_bytes(F.col("t")), t="é") == 2


def test_ids_and_digits(spark):
    import hashlib

    key = "java.base/java/lang/Object#hashCode()I"
    want = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
    assert int(_one(spark, scalars.stable_id(F.col("k")), k=key)) == want
    assert _one(spark, scalars.hash_fold(F.col("k"), 5), k="java.lang") == int.from_bytes(hashlib.sha256(b"java.lang").digest()[:4], "big") % 5
    for n, less in ((9, 3), (10**40, 1), (10**36 + 5, 7), (123 * 10**50, 9 * 10**17), (10**37, 10**10)):
        got = spark.createDataFrame([(str(n), less)], "d string, l bigint").select(scalars.digits_minus(F.col("d"), F.col("l")).alias("x")).first()["x"]
        assert got == str(n - less)
    assert _one(spark, scalars.percent_growth(F.col("a"), F.col("b")), a=110, b=100) == 10.0
    assert _one(spark, scalars.has_flag(F.col("f"), scalars.ACC_NATIVE), f=0x0108) is True


def test_contexts(spark):
    lines = ["variable (x : Nat)", "  {y : Nat}", "-- note", "  [z]", "open Foo", "def q := 1", "  (w)", "attribute [simp] a"]
    got = [spark.createDataFrame([(lines, k)], "l array<string>, k int").select(scalars.context_of(F.col("l"), F.col("k")).alias("c")).first()["c"] for k in range(8)]
    v = "probable_variable_continuation"
    assert got == ["explicit_variable", v, "other_command_or_continuation", v, "namespace_syntax_or_scope_command", "other_command_or_continuation", "other_command_or_continuation", "attribute_command"]


def test_streamed_shards_give_the_batch_result(spark, tmp_path):
    raw = spark.createDataFrame([("edge", "s", "a", "b", "TYPE", Decimal(2)), ("node", "s", None, None, None, None)], "record string, snapshot string, src string, dst string, edge_type string, multiplicity decimal(20,0)")
    sinks.json_lines(raw, str(tmp_path / "raw"))
    ingest.append_records(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    ingest.append_records(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert spark.read.parquet(str(tmp_path / "out")).where("record = 'edge'").count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_audits_name_what_fails(spark):
    from weftline.operators import audits

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k bigint, v string")
    asked = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k bigint")
    assert [r["v"] for r in audits.exactly_one(rows, asked(1, 1), ["k"]).collect()] == ["a"]
    for ks in ((2,), (7,)):
        with pytest.raises(ContractError):
            audits.exactly_one(rows, asked(*ks), ["k"])
    # Sets with nulls and repeated members.
    assert audits.set_difference(rows, asked(2, 1, None), ["k"]).count() == 0
    assert [tuple(r) for r in audits.set_difference(rows, asked(1, 2), ["k"]).collect()] == [("only_left", None)]
    assert [tuple(r) for r in audits.id_collisions(rows, "v", "k").collect()] == [(2, 2, "b", "c")]
    usages = spark.createDataFrame([("attributed",), ("attributed",), (None,)], "kind string")
    edges = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (3, None, 0)], "src bigint, dst bigint, multiplicity bigint")
    found = {r["check_name"]: r["failures"] for r in audits.conservation(usages, "kind", edges, ["src", "dst"]).collect()}
    assert found == {"unclassified_usages": 1, "multiplicity_differs_from_usages": 0, "repeated_edges": 1, "multiplicity_below_one": 1, "null_ends": 1}
    ratio = [r["x"] for r in audits.ratios(spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "a bigint, b bigint"), {"x": ("a", "b")}).collect()]
    assert ratio == [0.5, None, None]
    methods = spark.createDataFrame([(1, True), (2, False)], "method_id bigint, native boolean")
    calls = spark.createDataFrame([(1, 2, "STATIC"), (1, 9, "STATIC")], "caller_id bigint, callee_id bigint, invoke_kind string")
    links = spark.createDataFrame([(2,)], "multiplicity bigint")
    got = {r["check_name"]: r["failures"] for r in audits.call_acceptance(methods, calls, links, links.limit(0), ["STATIC", "DYNAMIC"], F.col("native"), F.col("native")).collect()}
    assert got == {"callers_that_are_no_method": 0, "callees_that_are_no_method": 1, "bodiless_methods_with_code": 1, "missing_invoke_kinds": 1, "typed_edges_lose_calls": 0, "core_links_lose_calls": 2}


def test_smallest_per_domain_rounds_as_its_sql(spark, tmp_path):
    """Prices on a half go to the even number: 1500.5 is within 1500, 1401.5 not within 1400, and 950.5 ties with 950."""
    import duckdb

    from weftline import catalog

    prices = [(1, "Brand#11", 950.5, 1), (2, "Brand#11", 950.0, 1), (3, "Brand#12", 1400.5, 2), (4, "Brand#13", 1401.5, 2), (5, "Brand#31", 1500.5, 48), (96, "Brand#31", 1500.5, 3)]
    spark.createDataFrame(prices, "p_partkey bigint, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["smallest_per_domain"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["smallest_per_domain"](spark, str(tmp_path)).collect()) == want


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """A graph query's tasks are bounded by the size of its tables; the next query finds the session as it was."""
    from weftline import catalog, session

    names = [session.INITIAL, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n, None) for n in names]
    monkeypatch.setattr(session, "TABLE_BYTES", 100)
    spark.range(3000).select((F.col("id") % 50).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = catalog.queries()["canonical_edges"](spark, str(tmp_path))
    assert edges.count() == 3000 and int(spark.conf.get(session.INITIAL)) > 50
    assert int(spark.conf.get(names[1])) <= session.MERGED_BYTES and int(spark.conf.get(names[2])) <= session.SPLIT_BYTES
    session.ready(spark)
    assert [spark.conf.get(n, None) for n in names] == before

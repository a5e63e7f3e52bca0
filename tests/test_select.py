import pytest
from pyspark.sql import functions as F

from lakeglass.plans.registry import QUERIES
from lakeglass.plans.select import SelectError, parse, select
from lakeglass.sources import readers, sinks


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("Alice", 30, True), ("Bob", 25, False), (None, None, None), ("a+b", 40, None)], "name string, age int, ok boolean")


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "standard", "compat"),
    [
        ("age > 28", ["Alice", "a+b"], ["Alice", "a+b"]),
        ("age = NULL", [], [None]),
        ("name = NULL", [], [None]),
        ("age IN (25, NULL)", ["Bob"], ["Bob", None]),
        ("age NOT IN (25, NULL)", [], ["Alice", "a+b"]),
        ("age IS NULL", [None], [None]),
        ("NOT age > 28", ["Bob"], []),
        ("age BETWEEN 26 AND 40", ["Alice", "a+b"], ["Alice", "a+b"]),
        ("age NOT BETWEEN 26 AND 40", ["Bob"], ["Bob", None]),
        ("name LIKE 'A%'", ["Alice"], ["Alice"]),
        ("name LIKE 'a+b'", ["a+b"], []),
        ("ok = true OR age > 35", ["Alice", "a+b"], ["Alice", "a+b"]),
        ("age / 0 IS NULL", ["Alice", "Bob", None, "a+b"], ["Alice", "Bob", None, "a+b"]),
        ("age + 1 = 31", ["Alice"], ["Alice"]),
        ("name || 'x' = 'Bobx'", ["Bob"], ["Bob"]),
        ("age <> 30", ["Bob", "a+b"], ["Bob", None, "a+b"]),
    ],
)
def test_modes(rows, where, standard, compat):
    assert names(select(rows, f"SELECT * FROM s3object WHERE {where}")) == standard
    assert names(select(rows, f"SELECT * FROM s3object WHERE {where}", mode="compat")) == compat


def test_mixed_types_are_unequal(rows):
    assert names(select(rows, "SELECT * FROM s WHERE name = 30", mode="compat")) == []
    assert len(names(select(rows, "SELECT * FROM s WHERE name <> 30", mode="compat"))) == 4
    assert names(select(rows, "SELECT * FROM s WHERE name < 30", mode="compat")) == []
    assert names(select(rows, "SELECT * FROM s WHERE nothing IS NULL", mode="compat")) == names(rows)
    assert names(select(rows, "SELECT * FROM s WHERE nothing = NULL", mode="compat")) == []


def test_projection_and_limit(rows):
    assert select(rows, "SELECT age AS years, name FROM s LIMIT 2").columns == ["years", "name"]
    assert select(rows, "SELECT age AS years, name, nothing FROM s", mode="compat").columns == ["name"]
    assert select(rows, "SELECT * FROM s LIMIT 2").count() == 2
    assert select(rows, "SELECT * FROM s; DROP TABLE x").count() == 4


@pytest.mark.parametrize("sql", ["DELETE FROM s", "SELECT a FROM s GROUP BY a", "SELECT FROM s", "SELECT a FROM s WHERE (a = 1"])
def test_rejected(sql):
    with pytest.raises(SelectError):
        parse(sql)


def test_unknown_column(rows):
    with pytest.raises(SelectError):
        select(rows, "SELECT nothing FROM s")


def test_csv_cells_have_their_own_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age,city\nAlice,30,NY\nBob,x,\nCarl,1e3,TRUE\nDora,NaN,LA\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    kinds = [r[0] for r in df.select(F.schema_of_variant("age")).collect()]
    assert kinds == ["BIGINT", "STRING", "DOUBLE", "STRING"]
    assert [r["n"] for r in select(df, "SELECT * FROM s WHERE age > 28", mode="compat").select(F.variant_get("name", "$", "string").alias("n")).collect()] == ["Alice", "Carl"]
    assert [r["n"] for r in select(df, "SELECT * FROM s WHERE city IS NULL", mode="compat").select(F.variant_get("name", "$", "string").alias("n")).collect()] == ["Bob"]
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), header="NONE", typed=False).columns == ["_1", "_2", "_3"]


def test_json_rows(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"name":"Alice","age":30}\n\n{"name":"Bob","age":25}\n7\n')
    rows = readers.read_json_variant(spark, str(tmp_path / "l.json"))
    assert rows.count() == 3
    assert rows.where(F.variant_get("row", "$._1", "int") == 7).count() == 1
    (tmp_path / "d.json").write_text('[{"a":1},{"a":2}]')
    assert readers.read_json_variant(spark, str(tmp_path / "d.json"), document=True).count() == 2


def test_ranges_and_objects(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"0123456789")
    df = readers.read_objects(spark, str(tmp_path))
    parts = df.select(readers.scan_range(F.col("content"), 2, 5).alias("a"), readers.scan_range(F.col("content"), 8, 99).alias("b"), readers.scan_range(F.col("content"), None, None).alias("c")).first()
    assert (bytes(parts["a"]), bytes(parts["b"]), bytes(parts["c"])) == (b"234", b"89", b"0123456789")


def test_prometheus(spark):
    h = spark.sql("select 'lat' as name, array(struct(1.0D as le, 2L as count)) as buckets, 3.5D as sum, 4L as count")
    c = spark.sql("select 'hits' as name, 'counter' as kind, 7 as value")
    lines = [r["value"] for r in sinks.prometheus(c, h).collect()]
    assert lines == ["# TYPE hits counter", "hits 7", "# TYPE lat histogram", 'lat_bucket{le="1.0"} 2', 'lat_bucket{le="+Inf"} 4', "lat_sum 3.5", "lat_count 4"]


def test_csv_quotes(spark):
    df = spark.createDataFrame([('a"b', 1, None), ("x,y", 2, "l\nm")], "a string, b int, c string")
    assert [r["value"] for r in sinks.csv_lines(df).collect()] == ['"a""b",1,', '"x,y",2,"l\nm"']


@pytest.mark.parametrize(
    ("where", "standard"),
    [
        ("CASE WHEN age > 28 THEN true ELSE false END", ["Alice", "a+b"]),
        ("CASE name WHEN 'Bob' THEN 1 WHEN 'Alice' THEN 2 END = 2", ["Alice"]),
        ("CAST(age AS STRING) = '25'", ["Bob"]),
        ("CAST(name AS INT) = 5 OR name IS NOT NULL", ["Alice", "Bob", "a+b"]),
        ("name ILIKE 'b%'", ["Bob"]),
        ("name NOT ILIKE 'b%'", ["Alice", "a+b"]),
        ("UPPER(name) = 'BOB' OR LOWER(SUBSTRING(name, 1, 2)) = 'al'", ["Alice", "Bob"]),
        ("CHAR_LENGTH(TRIM(name)) = 3", ["Bob", "a+b"]),
        ("COALESCE(age, 0) = 0", [None]),
        ("ABS(-age) = 30", ["Alice"]),
    ],
)
def test_expressions_that_compat_rejects(rows, where, standard):
    assert names(select(rows, f"SELECT * FROM s3object WHERE {where}")) == standard
    assert names(select(rows, f"SELECT * FROM s3object WHERE {where}", mode="compat")) == []


def test_unsupported_expressions(rows):
    for where in ("name SIMILAR TO 'a%'", "EXISTS (SELECT 1 FROM t WHERE (a = 1))"):
        assert names(select(rows, f"SELECT * FROM s WHERE {where} OR age = 30", mode="compat")) == []
        with pytest.raises(SelectError):
            select(rows, f"SELECT * FROM s WHERE {where}")
    for where in ("NOSUCH(name) = 1", "UPPER(name, age) = 'x'", "CAST(age AS NOSUCH) = 1"):
        with pytest.raises(SelectError):
            select(rows, f"SELECT * FROM s WHERE {where}")


def test_requests(spark, tmp_path):
    import gzip

    from lakeglass.plans.select import parse_request, run_request

    json_body = '{"Expression": "SELECT name FROM s3object WHERE age > 28", "ExpressionType": "SQL", "InputSerialization": {"JSON": {"Type": "LINES"}}, "OutputSerialization": {"CSV": {}}, "ScanRange": {"Start": 5, "End": 9}}'
    r = parse_request(json_body)
    assert (r.input_format, r.output_format, r.start, r.end, r.compression) == ("JSON", "CSV", 5, 9, "NONE")
    xml_body = """<?xml version="1.0"?><SelectObjectContentRequest xmlns="http://x"><Expression>SELECT name, city FROM s3object WHERE age &gt; 26</Expression><ExpressionType>SQL</ExpressionType>
      <InputSerialization><CompressionType>GZIP</CompressionType><CSV><FileHeaderInfo>USE</FileHeaderInfo></CSV></InputSerialization><OutputSerialization><JSON/></OutputSerialization></SelectObjectContentRequest>"""
    x = parse_request(xml_body.encode())
    assert (x.expression, x.input_format, x.compression, x.input_options) == ("SELECT name, city FROM s3object WHERE age > 26", "CSV", "GZIP", {"FileHeaderInfo": "USE"})
    (tmp_path / "users.json").write_text('{"name": "Alice", "age": 30}\n{"name": "Bob", "age": 25}\n{"name": "Charlie", "age": 35}\n')
    with gzip.open(tmp_path / "users.csv.gz", "wt") as f:
        f.write("name,age,city\nAlice,30,Rome\nBob,25,Oslo\nCharlie,35,Bern\n")
    assert [v["value"] for v in run_request(spark, json_body, str(tmp_path / "users.json")).collect()] == ["Alice", "Charlie"]
    assert [v["value"] for v in run_request(spark, xml_body, str(tmp_path / "users.csv.gz")).collect()] == ['{"name":"Alice","city":"Rome"}', '{"name":"Charlie","city":"Bern"}']
    for body in ("", "{}", "<a>", '{"Expression": "SELECT 1", "ExpressionType": "XPATH"}', b"\xff\xfe", '{"Expression": "x", "ExpressionType": "SQL"}', "<!DOCTYPE x><x/>"):
        with pytest.raises(SelectError):
            parse_request(body)
    with pytest.raises(SelectError):
        run_request(spark, xml_body, str(tmp_path / "users.json"))


def test_casts_to_whole_numbers_round(spark):
    df = spark.createDataFrame([(0.5, "7"), (1.5, "x"), (-2.5, "7.5"), (217583.99, None), (float("nan"), "1"), (1e300, "2"), (None, "3")], "x double, s string")
    got = select(df, "SELECT CAST(x AS INT) AS a, CAST(s AS INT) AS b, CAST(x AS STRING) AS c FROM s")
    assert got.schema["a"].dataType.simpleString() == "bigint"
    assert [r["a"] for r in got.collect()] == [0, 2, -2, 217584, None, None, None]
    assert [r["b"] for r in got.collect()] == [7, None, None, None, 1, 2, 3]
    assert got.first()["c"] == "0.5"


def test_select_functions_sees_whole_prices(spark, tmp_path):
    rows = [(1, "O", 200000.25, "2-HIGH"), (2, "P", 50000.5, "2-HIGH"), (3, "F", 50000.0, "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r["o_orderkey"], r["size"], r["whole"]) for r in QUERIES["select_functions"](spark, str(tmp_path)).collect())
    assert got == [(1, "large", 200000), (2, "middle", 50000), (3, "small", 50000)]

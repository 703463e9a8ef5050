"""Raw dump parsing (S1–S4, P1–P11) on FIXTURES F-1 and its edge cases."""

import os

from pyspark.sql import functions as F

from reqscope.functions import request as rq
from reqscope.sources.dumps import parse_dump_column, read_dump_files

F1 = """junk before the first request
GET http://h:8080/shop/list?id=1&x=&y HTTP/1.1
Host: h:8080
X-Dup: a
X-Dup: b
NoColon
Tight:v

POST http://h:8080/shop/pay HTTP/1.1
Content-Length: 20

a=1' OR 1=1--

b=%3Cscript%3E


GET /a b HTTP/1.1
"""


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def _rows(df):
    return [r.asDict() for r in df.orderBy("pos").collect()]


def test_fixture_f1(spark, tmpdir_path):
    p = _write(tmpdir_path, "dump.txt", F1.encode())
    req = rq.with_request_text(read_dump_files(spark, p, label=1))
    rows = _rows(req.withColumn("hm", rq.header_map(F.col("headers"))))
    assert len(rows) == 3
    r0, r1, r2 = rows
    assert (r0["method"], r0["target"], r0["version"]) == ("GET", "http://h:8080/shop/list?id=1&x=&y", "HTTP/1.1")
    assert [(h["name"], h["value"]) for h in r0["headers"]] == [
        ("Host", "h:8080"), ("X-Dup", "a"), ("X-Dup", "b"), ("NoColon", ""), ("Tight", "v")]
    assert r0["hm"]["X-Dup"] == "b"
    assert r0["body"] == "" and len(r0["raw"].split("\n")) == 6
    assert (r1["method"], r1["target"]) == ("POST", "http://h:8080/shop/pay")
    assert r1["body"] == "a=1' OR 1=1--\nb=%3Cscript%3E"
    assert len(r1["raw"].split("\n")) == 6
    assert (r2["method"], r2["target"], r2["version"]) == ("GET", "/a", "b HTTP/1.1")
    assert r2["headers"] == [] and r2["body"] == ""
    assert all(r["label"] == 1 for r in rows)
    assert r2["request_line"] == "GET /a b HTTP/1.1"


def test_crlf_equals_lf_and_lone_cr_splits(spark, tmpdir_path):
    a = _write(tmpdir_path, "lf.txt", F1.encode())
    b = _write(tmpdir_path, "crlf.txt", F1.replace("\n", "\r\n").encode())
    cols = ["pos", "method", "target", "version", "headers", "body", "raw"]
    ra = [tuple(r) for r in read_dump_files(spark, a).select(*cols).orderBy("pos").collect()]
    rb = [tuple(r) for r in read_dump_files(spark, b).select(*cols).orderBy("pos").collect()]
    assert ra == rb
    c = _write(tmpdir_path, "cr.txt", b"GET /x HTTP/1.1\rHost: h\n")
    r = read_dump_files(spark, c).collect()
    assert len(r) == 1 and r[0].headers[0].name == "Host"


def test_edge_cases(spark, tmpdir_path):
    empty = _write(tmpdir_path, "empty.txt", b"")
    assert read_dump_files(spark, empty).count() == 0
    junk = _write(tmpdir_path, "junk.txt", b"nothing here\nFOO /x HTTP/1.1\nGETX /y HTTP/1.1\n")
    assert read_dump_files(spark, junk).count() == 0
    bom = _write(tmpdir_path, "bom.txt", "\ufeffGET /a HTTP/1.1\nGET /b HTTP/1.1\n".encode())
    assert [r.target for r in read_dump_files(spark, bom).collect()] == ["/b"]
    bad = _write(tmpdir_path, "bad.txt", b"GET /\xff\xfe HTTP/1.1\n")
    assert read_dump_files(spark, bad).first().target == "/��"
    hdr = _write(tmpdir_path, "hdr.txt", b"GET / HTTP/1.1\nA:b: c\n")
    h = read_dump_files(spark, hdr).first().headers[0]
    assert (h.name, h.value) == ("A:b", "c")
    body = _write(tmpdir_path, "body.txt", b"POST / HTTP/1.1\n\nGET /inner HTTP/1.1\n")
    assert read_dump_files(spark, body).count() == 2
    ws = _write(tmpdir_path, "ws.txt", b"GET /a HTTP/1.1\nH: v\n   \t \n\nGET /b HTTP/1.1\n")
    rows = read_dump_files(spark, ws).orderBy("pos").collect()
    assert rows[0].raw == "GET /a HTTP/1.1\nH: v"


def test_column_path_matches_file_path(spark, tmpdir_path):
    p = _write(tmpdir_path, "dump.txt", F1.encode())
    cols = ["method", "target", "version", "headers", "body", "raw"]
    files = [tuple(r) for r in read_dump_files(spark, p).orderBy("pos").select(*cols).collect()]
    df = spark.createDataFrame([(1, F1)], "id long, text string")
    col = [tuple(r) for r in parse_dump_column(df, "id", "text").orderBy("block_no").select(*cols).collect()]
    assert files == col


def test_split_independent_block_numbering(spark, tmpdir_path):
    """Many tiny splits give the same blocks as one split (note A)."""
    blocks = "".join(f"GET /p{i} HTTP/1.1\nHost: h{i}\n\nbody{i}\n\n" for i in range(400))
    p = _write(tmpdir_path, "big.txt", ("junk\n" + blocks).encode())
    cols = ["pos", "target", "body", "raw"]
    one = [tuple(r) for r in read_dump_files(spark, p).select(*cols).orderBy("pos").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        many = [tuple(r) for r in read_dump_files(spark, p).select(*cols).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(one) == 400 and one == many
    assert one[7] == (7, "/p7", "body7", "GET /p7 HTTP/1.1\nHost: h7\n\nbody7")


def test_blank_and_carriage_return_lines_as_python_has_them(spark):
    """Blank lines by their first other character, CRs only looked for where there are any."""
    from reqscope.functions.request import split_lines
    from reqscope.functions.text import is_blank

    texts = ["", " ", "\t\x0b\x1c\x1f ", " x ", "x", " ", "\x85  ", "​", "a\r\r", "\r", "a\rb", "é \r", "\U0001f600", " " * 300 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert {r.i: r.b for r in df.select("i", is_blank(F.col("t")).alias("b")).collect()} == {i: not t.strip() for i, t in enumerate(texts)}
    got = {r.i: r.l for r in df.select("i", split_lines(F.concat(F.col("t"), F.lit("\nz\r"))).alias("l")).collect()}
    assert got == {i: [t.rstrip("\r"), "z"] for i, t in enumerate(texts)}
    assert spark.range(1).select(is_blank(F.lit(None).cast("string")).alias("b")).first().b is None


def test_lines_are_exploded_without_parsing_again(spark):
    """The plan holds the parse once, not once more for each use in a test below the explode."""
    from reqscope.operators.embed import request_lines
    from reqscope.plans.queries import q_explode_lines
    from reqscope.sources import views

    r = rq.with_request_text(views.page_requests(spark, "/root/testdata/sf0.001"))
    for df in (q_explode_lines(spark, "/root/testdata/sf0.001"), request_lines(r)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    df = spark.createDataFrame([(1, ["a", None, ""]), (2, []), (3, None)], "pos long, lines array<string>")
    assert sorted((x.pos, x.line_no, x.line) for x in rq.exploded_lines(df, "pos").collect()) == [(1, 0, "a"), (1, 1, None), (1, 2, "")]
    assert [(x.pos, x.line) for x in request_lines(df).collect()] == [(1, "a"), (1, None), (1, "")]

"""Places of findings and the reach of words in other scripts: the scan and its SQL, and by hand."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from sentrylake.functions.portable import portable
from sentrylake.plans import scans

TEXTS = (
    "x ignore previous instructions\nabc ignore previous instructions you are now",  # a column counts from its own line, whatever earlier lines hold
    "dané mandatory first response protocol, caféignore previous instructionsé",  # letters of other scripts bound no word of ASCII
    "skip\u000bconfirmation api_key\u000b=\u000b'abcdefgh1' when\u0085today",
    "<!-- ```sh\neval (x)\n``` you are now -->\nword",  # parts of parts
    "\n".join(f"<!-- c{k} you are now -->" for k in range(70)),
    None,
)


def test_columns_equal_those_of_the_sql(spark, tmp_path):
    ids = [23 + k for k in range(len(TEXTS))]  # no payloads
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": TEXTS, "lang": ["en"] * len(ids), "source": ["s"] * len(ids)}), tmp_path / "documents.parquet")
    got = sorted(map(tuple, scans.QUERIES["finding_columns"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert got == sorted(con.execute(scans.ORACLE_SQL["finding_columns"]).fetchall())
    assert sorted((line, column) for _, rule, path, line, column in got if rule == "D-11A" and path == "s/23.md") == [(1, 3), (2, 5)]
    found = {(rule, path) for _, rule, path, *_ in got}
    assert ("D-11G", "s/24.md") in found and ("D-11A", "s/24.md") in found and ("D-10A", "s/26.md") in found
    assert sum(path == "s/27.md" and rule == "D-11B" for _, rule, path, *_ in got) == 70 + 64  # a file's own and its first 64 parts'


def test_portable_patterns(spark):
    rows = [("édan", r"\bdan\b"), ("dans", r"\bdan\b"), ("a\u000bb", r"a\sb"), ("ab\n", "ab$"), ("a\rb", "a.b"), ("a\rb", "(?m)^b"), ("a b", r"a[\s]b"), ("x(run)", r"\b(?:run|go)\b"), ("xrun", r"\b(?:run|go)\b")]
    table = spark.createDataFrame([(k, t, portable(p)) for k, (t, p) in enumerate(rows)], "k int, t string, p string")
    assert [x.m for x in table.selectExpr("k", "regexp_like(t, p) as m").orderBy("k").collect()] == [True, False, False, False, True, False, False, True, False]
    assert portable(r"(?i)\b(?:run|go)\b") == r"(?i)(?<!\w)(?:run|go)(?!\w)"
    assert portable(r"\b(?:run|)x") == r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))(?:run|)x" and portable(r"(?:a|-)\b") == r"(?:a|-)(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"

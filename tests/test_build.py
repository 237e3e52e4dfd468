"""Lexicon build from text files, written here in the four line formats."""

import pytest

from glossa.operators import lexicon as ops
from glossa.plans.build import build_lexicon, build_report
from glossa.plans.search import SearchRun
from glossa.sources import files
from glossa.sources.tables import Lexicon

BILINGUAL = """# a comment

貓 猫 [mao1] /cat/CL:隻|只[zhi1]/Cat/
貓狗 猫狗 [mao1 gou3] /cats and dogs/ pets # /not kept/\r
鳥 鸟 [niao3] /bird/
broken line
"""
ROMANISED = """貓 猫 [mao1] {maau1} /(slang) spy/ # note
壞 坏 [huai4] {waai9} /tone out of range/
"""
READINGS = """# readings
貓 猫 [mao1] {maau1}
貓 猫 [mao1] {miu4}
貓狗 猫狗 [mao1 gou3] {maau1 gau2}
"""
CHAR_FREQ = """# idx ch count cum
1\t一\t900\t10.0\tyi\tone
2\t貓\t500\t60.0\tmao\tcat
3\t一\t100\t61.0\tyi\tagain
x\t狗\t1\t2.0\tgou\tdog
"""


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    out = []
    for name, body in (("b", BILINGUAL), ("r", ROMANISED), ("j", READINGS), ("f", CHAR_FREQ)):
        (root / name).write_text(body, encoding="utf-8", newline="")
        out.append(str(root / name))
    return out


@pytest.fixture(scope="module")
def built(spark, paths):
    return build_lexicon(spark, *paths)


def test_entries(built):
    got = [
        (r["entry_id"], r["headword"], [(s["base"], s["tone"]) for s in r["syllables"]], r["definitions"], r["static_cost"], r["source"])
        for r in built.lexicon.entries.orderBy("entry_id").collect()
    ]
    assert got == [
        # f(貓) = 0.5 -> 693; no (Cantonese) 2000
        (0, "貓", [("maau", 1)], ["cat", "CL:隻|只[zhi1]"], 693 + 2000, "CEDict"),
        # 狗 is unknown, 7000; no M:/CL: 5000
        (1, "貓狗", [("maau", 1), ("gau", 2)], ["cats and dogs", "pets"], 693 + 7000 + 7000, "CEDict"),
        (2, "貓", [("maau", 1)], ["(slang) spy"], 15000 + 1000 + 7000, "CCanto"),
        # no reading 10000
        (3, "鳥", [], ["bird"], 7000 + 7000 + 10000, "CEDict"),
    ]


def test_rejects(built):
    got = sorted((r["reason"], r["line"]) for r in built.rejects.collect())
    assert got == [
        ("bilingual line", "broken line"),
        ("character frequency line", "x\t狗\t1\t2.0\tgou\tdog"),
        ("tone out of range", "壞 waai9"),
    ]


def test_frequencies_last_row_wins(spark, paths):
    rows = {r["ch"]: r for r in ops.char_frequencies(files.parse_char_freq(files.read_lines(spark, paths[3]))).collect()}
    assert set(rows) == {"一", "貓"}
    assert rows["一"]["idx"] == 3 and rows["一"]["cost"] == 4605  # 0.01
    assert rows["貓"]["cost"] == 693


def test_file_order_survives_splits(spark, tmp_path):
    lines = [f"字{i} x [p] {{a{i % 7 + 1}}}" for i in range(5000)]
    (tmp_path / "r").write_text("\n".join(lines), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        read = files.read_lines(spark, str(tmp_path / "r"))
        assert read.rdd.getNumPartitions() > 4
        assert [r["headword"] for r in files.parse_readings(read).orderBy("line_no").collect()] == [f"字{i}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_round_trip_and_version(spark, built, make_queries, tmp_path):
    path = str(tmp_path / "lexicon")
    built.lexicon.save(path)
    loaded = Lexicon.load(spark, path)
    for name in ("entries", "syllables", "characters", "words"):
        assert sorted(map(str, getattr(loaded, name).collect())) == sorted(map(str, getattr(built.lexicon, name).collect()))
    got = SearchRun(make_queries(["maau", "dogs"]), loaded).ranked().orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["entry_id"], r["total_cost"]) for r in got] == [
        (0, 0, 2693),
        (0, 2, 23000),
        (0, 1, 14693 + 20000),
        (1, 1, 14693 + 5000 + 900),
    ]
    spark.range(1).selectExpr("7 as version").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError):
        Lexicon.load(spark, path)


def test_report(built):
    r = build_report(built.lexicon).first()
    assert (r["n_entries"], r["n_bilingual"], r["n_romanised"], r["n_definitions"]) == (4, 3, 1, 6)
    assert (r["n_characters"], r["n_syllables"]) == (3, 2)


def test_readings_grouped(spark):
    rows = spark.createDataFrame([(1, "x", "B"), (2, "x", "a"), (3, "x", "b"), (4, "y", "A")], "line_no int, headword string, reading string")
    got = {r[0]: r[1] for r in ops.grouped_ci(rows, "headword", "reading", "rs").collect()}
    assert got == {"x": ["B", "a"], "y": ["A"]}
    back = {r[0]: r[1] for r in ops.grouped_ci(rows, "reading", "headword", "hs").collect()}
    assert back == {"B": ["x"], "a": ["x"], "b": ["x"], "A": ["y"]}

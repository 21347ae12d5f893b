import os
import random

import pytest
from pyspark.sql import functions as F

from polystrand.operators import index as ix
from polystrand.operators import leds, msa, query, report, vcf
from polystrand.sources import eds

ROW1, SRC1 = "{ACGT}{A,ACA}{CGT}{T,TG}", "{0}{1,3}{2}{0}{1}{2,3}"
SF = "/root/testdata/sf0.001"


def symbols(spark, text, seds=None):
    return eds.parse(eds.from_strings(spark, [("x", text, seds)]) if seds else spark.createDataFrame([("x", text)], "eds_id string, eds string"))


def full(df):
    return eds.serialize(df).first()[1]


def sources(df):
    return eds.serialize_sources(df).first()[1]


def test_statistics(spark):
    s = ix.eds_statistics(symbols(spark, ROW1)).first()
    assert (s.n, s.m, s.n_chars, s.num_degenerate, s.min_ctx, s.max_ctx, s.avg_ctx, s.common_chars, s.change_size, s.empty_strings) == (4, 6, 14, 2, 3, 4, 3.5, 7, 2, 0)
    s = ix.source_statistics(symbols(spark, ROW1, SRC1)).first()
    assert (s.num_paths, s.max_paths_per_string, s.avg_paths_per_string) == (4, 2, round(8 / 6, 6))
    s = ix.eds_statistics(symbols(spark, "{AC}{,A,T}{GT}")).first()
    assert (s.n, s.m, s.empty_strings, s.num_degenerate, s.change_size) == (3, 5, 1, 1, 2)


def test_texts(spark):
    assert full(symbols(spark, "ACGT{A,ACA}CGT{T,TG}")) == ROW1
    assert full(symbols(spark, "{ ACGT } { A , ACA } { CGT }")) == "{ACGT}{A,ACA}{CGT}"
    assert eds.serialize(symbols(spark, ROW1), compact=True).first()[1] == "ACGT{A,ACA}CGT{T,TG}"
    assert sources(symbols(spark, ROW1, SRC1)) == SRC1
    assert symbols(spark, "").count() == 0


@pytest.mark.parametrize("text,seds,status", [("ACGT}", None, "MISSING_OPEN"), ("{ACGT", None, "MISSING_CLOSE"), ("{A{B}", None, "MISSING_CLOSE"), ("{A}{B,C}", "{1}{2}", "CARDINALITY"), ("{A}", "{}", "EMPTY_SET"), ("{A}", "{-1}", "BAD_CHARACTER"), ("{A}", "", "EMPTY_SOURCES"), ("", None, "OK"), (ROW1, SRC1, "OK")])
def test_validation(spark, text, seds, status):
    assert eds.validate(eds.from_strings(spark, [("x", text, seds)])).first().status == status


@pytest.mark.parametrize("text,seds,merged,paths", [("{G,C}{T}", None, "{GT,CT}", None), ("{,A}{T}", None, "{T,AT}", None), ("{G,C}{T}", "{1,2}{2,3}{2}", "{GT,CT}", "{2}{2}"), ("{A,B}{C,D}", "{1}{2}{1}{3}", "{AC}", "{1}"), ("{A,B}{C}", "{0}{2}{1}", "{AC}", "{1}"), ("{A}{B}", "{0}{0}", "{AB}", "{0}")])
def test_merge(spark, text, seds, merged, paths):
    out = leds.merge_adjacent(symbols(spark, text, seds), 0, 1, linear=seds is not None)
    assert full(out) == merged
    assert seds is None or sources(out) == paths


@pytest.mark.parametrize("text,seds", [("{A}{B}", "{1}{2}{3}"), ("{A}{B}", "{1}{}"), ("{A}{B}", "{1}"), ("{A}", "{99999999999}"), ("{A}", "{x}"), ("{A", "{1}")])
def test_strict_sources(spark, text, seds):
    with pytest.raises(Exception, match="malformed EDS or sources"):
        symbols(spark, text, seds).collect()
    rows = eds.from_strings(spark, [("x", text, seds), ("y", "{A}", "{1}")])
    assert {r.eds_id for r in eds.parse(rows, strict=False).collect()} == {"y"}
    assert eds.validate(rows).where("status = 'OK'").count() == 1


def test_sources_of_files(spark):
    texts = spark.createDataFrame([("x", "{A}{B}"), ("y", "{C}")], "eds_id string, eds string")
    found = spark.createDataFrame([("x", "{1}{2}")], "eds_id string, seds string")
    assert sources(eds.parse(eds.load_sources(texts.where("eds_id = 'x'"), found))) == "{1}{2}"
    with pytest.raises(Exception, match="no sources"):
        eds.parse(eds.load_sources(texts, found)).collect()
    with pytest.raises(Exception, match="no sources are loaded"):
        eds.serialize_sources(symbols(spark, "{A}")).collect()


def test_numbers_out_of_range(spark):
    lines = ["1\t99999999999999999999\t.\tA\tC", "   ", "", "1\t5\t.\tA\tC\t.\t.\t.\tGT\t99999999999|1"]
    rows = vcf.parse(spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "vcf_id string, line_no long, line string")).orderBy("line_no").collect()
    assert [r.status for r in rows] == ["MALFORMED", "MALFORMED", "HEADER", "NONE"] and rows[3].gts == [[1]]
    assert eds.validate(eds.from_strings(spark, [("x", "{A}", "{99999999999}")])).first().status == "BAD_NUMBER"
    name, seq = vcf.parse_fasta(spark.createDataFrame([("v", ">chr1 \r\nAC\r\nGT\r\n")], "vcf_id string, text string")).select("name", "seq").first()
    assert (name, seq) == ("chr1", "ACGT")


def test_reports(spark):
    import json

    rows = symbols(spark, "{ACGT}{A,}{CGT}{T,TG}", "{0}{1,3}{2}{0}{1}{2,3}")
    full_mode = json.loads(report.stats_json(rows).first()["json"])
    assert full_mode["structure"] == {"n_symbols": 4, "N_characters": 11, "m_strings": 6, "degenerate_symbols": 2, "regular_symbols": 2}
    assert full_mode["memory"]["mode"] == "FULL" and full_mode["sources"] == {"loaded": True, "file_provided": True, "num_paths": 4, "max_paths_per_string": 2, "avg_paths_per_string": 1.33}
    assert full_mode["context_lengths"] == {"min": 3, "max": 4, "avg": 3.5} and full_mode["recommendations"]["needs_transformation"] is True
    index_only = json.loads(report.stats_json(symbols(spark, "{ACGTA}"), index_only=True).first()["json"])
    assert index_only["memory"]["reduction_factor"] == round(73 / 93, 1) and index_only["sources"]["loaded"] is False and index_only["recommendations"]["ready_for_indexing"] is True
    text = report.stats_text(rows, verbose=True).first()["text"]
    assert "Sources: 4 paths" in text and "Degenerate symbols, %" in text and "Advice: transform" in text
    lines = [r.line for r in report.symbol_lines(rows).orderBy("pos").collect()]
    assert lines[:2] == ['Set 0: {"ACGT"}', 'Set 1: {"A", ε} [degenerate]']
    sizes = spark.createDataFrame([(x,) for x in (0, 1023, 1024, 1536, 5 * 1024**3, 3 * 1024**5)], "x long").select(report.format_size(F.col("x")), report.format_number(F.col("x"))).collect()
    assert [r[0] for r in sizes] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 GB", "3072.0 TB"] and sizes[3][1] == "1,536"


def test_figures_as_the_reference_prints_them(spark):
    rnd = random.Random(3)
    values = [0.0, 2.125, 2.375, 0.125, 2.005, 1.015, 0.285, 2.675, 0.005, 0.995, 9.995, 1e-9, 123456789.125, *(rnd.random() * 10 ** rnd.randrange(-3, 9) for _ in range(500)), *(rnd.randrange(10**5) / 8 for _ in range(100))]
    found = spark.createDataFrame([(x,) for x in values], "x double").select("x", report.fixed(F.col("x"), 2), report.fixed(F.col("x"), 1)).collect()
    assert [tuple(r) for r in found] == [(x, f"{x:.2f}", f"{x:.1f}") for x in values]


def against_sql(spark, path, name):
    """Rows of a query and of its SQL over the tables in ``path``."""
    import duckdb

    from polystrand.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(path):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}/{f}{'/*.parquet' if os.path.isdir(f'{path}/{f}') else ''}')")
    df = QUERIES[name](spark, str(path))
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
    shown = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    return shown(df.collect()), shown(want)


def test_large_strings_against_sql(spark, tmp_path):
    lines = lambda o: 1 if o % 3 == 0 else 4
    spark.range(1200).selectExpr("id o_orderkey", "1 + id % 2 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(o, n, o * 7 + n * 3, o % 11) for o in range(1200) for n in range(lines(o))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found, want = against_sql(spark, tmp_path, "stats_text")
    assert found == want and int(found[0][2]) >= 1000
    found, want = against_sql(spark, tmp_path, "parse_seds")
    assert found == want


def test_no_symbol_carries_its_whole_string(spark, monkeypatch):
    rows = symbols(spark, ROW1, SRC1)
    assert sources(rows) == SRC1 and "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    plans = []

    def noted(df, write=leds.cut):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(leds, "cut", noted)
    assert sources(leds.to_leds(rows, 3, linear=True)) == SRC1
    assert plans and not any("collect_list(_u" in p for p in plans)


def brute_leds(parts, least, linear):
    """Merges the leftmost breaking pairs, round by round, on plain lists of (text, paths)."""

    def meet(a, b):
        return {0} if 0 in a and 0 in b else b if 0 in a else a if 0 in b else a & b

    while True:
        n = len(parts)
        short = [len(p) == 1 and 0 < i < n - 1 and len(p[0][0]) < least for i, p in enumerate(parts)]
        bad = [i for i in range(n - 1) if short[i] or short[i + 1] or len(parts[i]) > 1 < len(parts[i + 1])]
        if not bad:
            return parts
        picked, last = set(), -2
        for i in bad:
            if i > last + 1:
                picked.add(last := i)
        out, i = [], 0
        while i < n:
            if i in picked:
                both = [(x + y, meet(a, b) if linear else None) for x, a in parts[i] for y, b in parts[i + 1]]
                out.append([p for p in both if not linear or p[1]])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("linear", [False, True])
def test_least_context_by_brute_force(spark, linear):
    """Random strings, adjacent symbols of one alternative among them, many at once."""
    rnd, texts, want = random.Random(5 + linear), [], {}
    for k in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 9)):
            n = rnd.choice([1, 1, 2, 3])
            paths = [{0}] if n == 1 else [{j + 1} for j in range(n - 1)] + [set(range(n, 5))]
            parts.append([("".join(rnd.choices("ACGT", k=rnd.randrange(0 if n > 1 else 1, 5))), p) for p in paths])
        texts.append((f"e{k}", "".join("{" + ",".join(s for s, _ in p) + "}" for p in parts), "".join("{" + ",".join(map(str, sorted(q))) + "}" for p in parts for _, q in p)))
        want[f"e{k}"] = brute_leds(parts, 3, linear)
    rows = eds.parse(eds.from_strings(spark, texts))
    found = leds.to_leds(rows, 3, linear=linear).orderBy("eds_id", "pos").collect()
    have = {}
    for r in found:
        have.setdefault(r.eds_id, []).append([(a.s, set(a.src) if linear else None) for a in r.alts])
    plain = {k: [[(s, q if linear else None) for s, q in p] for p in v] for k, v in want.items()}
    assert have == plain


def test_groups_in_stretches(spark, monkeypatch):
    rnd = random.Random(2)
    spans = sorted((rnd.randrange(1, 400), rnd.randrange(1, 12)) for _ in range(60))
    rows = vcf.parse(spark.createDataFrame([("v", i, f"1\t{p}\t.\t{'A' * n}\tC") for i, (p, n) in enumerate(spans)], "vcf_id string, line_no long, line string"))
    want, reach, group = [], 0, -1
    for p, n in spans:
        group += p - 1 >= reach or group < 0
        reach = max(reach, p - 1 + n)
        want.append(group)
    for stretch in (1 << 16, 8):
        monkeypatch.setattr(vcf, "STRETCH", stretch)
        assert [r.group_no for r in vcf.groups(rows).orderBy("pos", "line_no").collect()] == want


def test_walks_in_buckets(spark, monkeypatch):
    rows = symbols(spark, "{ACGT}{A,ACA}{CGT}{T,TG}{AA}")
    asked = spark.createDataFrame([("x", 1, 0, [1, 3], "ACGTACACGTTGAA"), ("x", 2, 5, [2], "GTTA"), ("x", 3, 6, [3], "TTGAC")], "eds_id string, qid long, common_pos long, deg array<int>, pattern string")
    for span in (4096, 2):
        monkeypatch.setattr(query, "SPAN", span)
        monkeypatch.setattr(ix, "SPAN", span)
        assert {r.qid: r.status for r in query.check_position(ix.index(rows), asked).collect()} == {1: "MATCH", 2: "MATCH", 3: "NO_MATCH"}
        cut = spark.createDataFrame([("x", 1, 1, 3, [1, 0, 1])], "eds_id string, qid long, pos long, len long, changes array<int>")
        assert ix.extract(rows, cut).first().text == "ACACGTTG"


def test_merge_errors(spark):
    with pytest.raises(ValueError):
        leds.merge_adjacent(symbols(spark, "{A}{B}{C}"), 0, 2)
    with pytest.raises(Exception, match="out of range"):
        leds.merge_adjacent(symbols(spark, "{A}{B}"), 1, 2).collect()
    with pytest.raises(Exception, match="empty set"):
        leds.merge_adjacent(symbols(spark, "{A,B}{C,D}", "{1}{2}{3}{4}"), 0, 1, linear=True).collect()


@pytest.mark.parametrize("text,least,out", [(ROW1, 5, "ACGT{ACGTT,ACGTTG,ACACGTT,ACACGTTG}"), ("{A,T}{G,C}", 1, "{AG,AC,TG,TC}"), ("{AAAA}{A,T}{GTT}{A,T}{CCCC}", 4, "AAAA{AGTTA,AGTTT,TGTTA,TGTTT}CCCC"), ("{AAAA}{AGT}{GTT}{CCCC}", 4, "AAAAAGTGTTCCCC"), ("{AG}{TTTT}{CCCC}", 4, "AGTTTTCCCC")])
def test_least_context(spark, text, least, out):
    found = leds.to_leds(symbols(spark, text), least)
    assert eds.serialize(found, compact=True).first()[1] == out
    assert leds.is_leds(found, least).first().is_leds


def test_long_runs_of_few_paths(spark):
    text, seds = "{GGGG}" + "{G}".join(["{A,C}"] * 23) + "{TTTT}", "{0}" + "{0}".join(["{1}{2,3}"] * 23) + "{0}"
    found = leds.to_leds(symbols(spark, text, seds), 3, linear=True)
    assert full(found) == "{GGGG}{" + "G".join("A" * 23) + "," + "G".join("C" * 23) + "}{TTTT}"
    assert sources(found) == "{0}{1}{2,3}{0}"
    with pytest.raises(Exception, match="too many"):
        leds.to_leds(symbols(spark, text), 3).collect()


@pytest.mark.parametrize("seds,pos,deg,pattern,status", [
    (None, 0, [], "ACG", "MATCH"), (None, 1, [], "CGT", "MATCH"), (None, 5, [2], "GTT", "MATCH"), (None, 5, [3], "GTT", "MATCH"), (None, 0, [0, 2], "ACGTACGTT", "MATCH"), (None, 0, [1, 2], "ACGTACACGTT", "MATCH"),
    (None, 0, [], "XYZ", "NO_MATCH"), (None, 4, [0], "ACG", "NO_MATCH"), (None, 100, [], "ACG", "NO_MATCH"), (None, 0, [], "ACGTX", "TOO_FEW_CHOICES"), (None, 4, [], "ACGTT", "TOO_FEW_CHOICES"), (None, 4, [0, 2], "ACGTT", "WRONG_SYMBOL"),
    (None, 6, [1], "ACG", "WRONG_SYMBOL"), (None, 4, [999], "ACG", "NO_MATCH"), (None, 5, [999], "GTT", "BAD_CHOICE"), (None, 0, [], "", "MATCH"), (SRC1, 0, [1, 2], "ACGTACACGTT", "NO_MATCH"), (SRC1, 0, [0, 2], "ACGTACGTT", "MATCH"),
])
def test_positions(spark, seds, pos, deg, pattern, status):
    asked = spark.createDataFrame([("x", 1, pos, deg, pattern)], "eds_id string, qid long, common_pos long, deg array<int>, pattern string")
    assert query.check_position(ix.index(symbols(spark, ROW1, seds)), asked).first().status == status


def test_extract(spark):
    rows = symbols(spark, "{ACGT}{A,CA}{GG}{T,TT}")
    asked = spark.createDataFrame([("x", 1, 1, 2, [0, 0]), ("x", 2, 1, 2, [1, 0]), ("x", 3, 3, 1, [1]), ("x", 4, 1, 2, [0]), ("x", 5, 1, 1, [7]), ("x", 6, 9, 1, [0])], "eds_id string, qid long, pos long, len long, changes array<int>")
    found = {r.qid: (r.status, r.text) for r in ix.extract(rows, asked).collect()}
    assert found == {1: ("OK", "AGG"), 2: ("OK", "CAGG"), 3: ("OK", "TT"), 4: ("WRONG_COUNT", None), 5: ("BAD_CHOICE", None), 6: ("OUT_OF_RANGE", None)}


@pytest.mark.parametrize("rows,least,text,paths", [
    (["AGTC--TCTATA", "AGTCCCTATATA", "AGTC--TATATA"], 0, "{AGTC}{,CC}{T}{C,A}{TATA}", "{0}{1,3}{2}{0}{1}{2,3}{0}"), (["AGTC--TCTATA", "AGTCCCTATATA", "AGTC--TATATA"], 4, "{AGTC}{TC,CCTA,TA}{TATA}", "{0}{1}{2}{3}{0}"),
    (["AGTCTA"] * 2, 0, "{AGTCTA}", "{0}"), (["AGTC", "AGCC"], 0, "{AG}{T,C}{C}", "{0}{1}{2}{0}"), (["--AGTC", "CCAGTC"], 0, "{,CC}{AGTC}", "{1}{2}{0}"), (["AG-C"], 0, "{AGC}", "{0}"),
])
def test_alignments(spark, rows, least, text, paths):
    found = msa.parse(spark.createDataFrame([("x", "".join(f">s{i}\n{r[:3]}\n{r[3:]}\n" for i, r in enumerate(rows)))], "msa_id string, text string"))
    out = msa.to_symbols(found, least)
    assert (full(out), sources(out)) == (text, paths)


def test_variants(spark):
    lines = ["##x", "1 5 . A C . . . GT 0|1 0|0".replace(" ", "\t"), "1 5 . A G . . . GT 1|0 1|1".replace(" ", "\t"), "1\t7\t.\tA\t<INV>\t.", "1\tx\t.\tA\tC"]
    rows = vcf.parse(spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "vcf_id string, line_no long, line string"))
    assert [r.status for r in rows.orderBy("line_no").collect()] == ["HEADER", "NONE", "NONE", "UNSUPPORTED_SV", "MALFORMED"]
    fasta = vcf.parse_fasta(spark.createDataFrame([("v", ">c\nACGTA\nCGTACGT\n")], "vcf_id string, text string"))
    out = vcf.to_symbols(rows, fasta)
    assert (full(out), sources(out)) == ("{ACGT}{A,C,G}{CGTACGT}", "{0}{1,2}{1}{1,2}{0}")
    s = vcf.statistics(rows).first()
    assert (s.total, s.processed, s.malformed, s.unsupported, s.groups) == (4, 2, 1, 1, 1)


def test_reference_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vcf, "PIECE", 3, raising=False)
    rnd = random.Random(4)
    seq = "".join(rnd.choices("ACGT", k=50))
    lines = [f"1\t{p}\t.\t{seq[p - 1 : p - 1 + n] or 'A'}\tT\t.\t.\t.\tGT\t0|1" for p, n in ((2, 1), (3, 1), (9, 11), (27, 2), (28, 4), (49, 5), (70, 1))]
    rows = vcf.parse(spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "vcf_id string, line_no long, line string"))
    fasta = vcf.parse_fasta(spark.createDataFrame([("v", f">c\n{seq}\n"), ("w", ">d\nACGTACGTA")], "vcf_id string, text string"))
    spans = {(r.begin, r.end): r.hap for r in vcf.haplotypes(rows, fasta).where("first.v = 0").collect()}
    assert spans == {(b, e): seq[b:e] for b, e in ((1, 2), (2, 3), (8, 19), (26, 31), (48, 50), (69, 70))}
    out = {r.eds_id: r.eds for r in eds.serialize(vcf.to_symbols(rows, fasta)).collect()}
    want = [seq[0], f"{seq[1]},T", f"{seq[2]},T", seq[3:8], f"{seq[8:19]},T", seq[19:26], None, seq[31:48], f"{seq[48:50]},T", ",T"]
    found = out["v"].strip("{}").split("}{")
    assert out["w"] == "{ACGTACGTA}" and [w or f for w, f in zip(want, found, strict=True)] == found and found[6].startswith(f"{seq[26:31]},")
    # no row holds a whole text and its distance in it: the plan cuts the text into pieces
    assert "substring(seq" not in vcf.haplotypes(rows, fasta)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_against_sql(spark):
    import duckdb

    from polystrand.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    shown = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
        assert shown(df.select(*columns).collect()) == shown(want), name


def test_index_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(ix, "BUCKET", 2)
    rows = ix.index(symbols(spark, ROW1)).orderBy("pos").select("cum_set", "cum_common", "cum_deg").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 4, 0), (3, 4, 2), (4, 7, 2)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert F.col("n") is not None and e.entry(spark).count() > 0

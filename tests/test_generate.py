from pyspark.sql import functions as F

from polystrand import cli
from polystrand.operators import generate
from polystrand.operators import index as ix
from polystrand.streaming import vcf_lines


def test_random_eds(spark):
    for context in (0, 3):
        rows = generate.random_eds(spark, "r", 200, 20, max_alts=4, min_context=context, seed=3).orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(len(rows)))
        varied = [r for r in rows if len(r.alts) > 1]
        assert len(varied) == 20 and sum(len(r.alts[0].s) for r in rows) == 200
        for r in varied:
            assert sorted(p for a in r.alts for p in a.src) == [1, 2, 3, 4] and all(a.src for a in r.alts)


def test_long_insertions(spark):
    rows = generate.random_eds(spark, "r", 300, 60, max_alts=4, snp_ratio=0.1, seed=2, min_alts=3, longest=6).collect()
    varied = [r for r in rows if len(r.alts) > 1]
    assert {len(r.alts) for r in varied} == {3, 4}
    lengths = {len(a.s) for r in varied for a in r.alts[1:]}
    assert 0 in lengths and max(lengths) == 7 and lengths <= set(range(8))


def test_patterns(spark):
    """Every pattern is a walk: the end of a common symbol, then a choice a symbol."""
    index = ix.index(generate.random_eds(spark, "r", 100, 10, seed=5))
    symbols = [[a.s for a in r.alts] for r in index.orderBy("pos").collect()]
    first = "".join(s[0] for s in symbols)

    def walks(pattern: str, wrap: bool) -> bool:
        for i, own in enumerate(symbols):
            for at in range(len(own[0]) if len(own) == 1 else 0):
                texts = {own[0][at:]}
                for later in symbols[i + 1 :]:
                    texts = {t if len(t) >= len(pattern) else t + s for t in texts for s in later}
                    texts = {t for t in texts if pattern.startswith(t[: len(pattern)])}
                ends = {(t + first * 3 if wrap else t)[: len(pattern)] for t in texts}
                if pattern in ends:
                    return True
        return False

    for wrap, length in ((True, 12), (False, 9), (True, 130)):
        rows = generate.generate_patterns(index, 20, length, wrap=wrap).collect()
        assert len(rows) == 20 and all(len(r.pattern) == length or not wrap for r in rows)
        assert all(walks(r.pattern, wrap) for r in rows)


def test_tools(spark, tmp_path, capsys):
    (tmp_path / "a.msa").write_text(">1\nAGTC--TCTATA\n>2\nAGTCCCTATATA\n>3\nAGTC--TATATA\n")
    cli.main(["msa2eds", "-i", str(tmp_path / "a.msa")])
    assert (tmp_path / "a.eds").read_text() == "{AGTC}{,CC}{T}{C,A}{TATA}\n" and (tmp_path / "a.seds").read_text() == "{0}{1,3}{2}{0}{1}{2,3}{0}\n"
    cli.main(["eds2leds", "-i", str(tmp_path / "a.eds"), "-l", "4"])
    assert (tmp_path / "a_l4.leds").read_text() == "AGTC{TC,TA,CCTC,CCTA}TATA\n"
    cli.main(["stats", "-i", str(tmp_path / "a.eds")])
    assert "Number of symbols (n)                    5" in capsys.readouterr().out
    cli.main(["stats", "-j", "-f", "-i", str(tmp_path / "a.eds"), "-s", str(tmp_path / "a.seds"), "-p"])
    out = capsys.readouterr().out
    assert '"n_symbols":5' in out and '"storage_mode":"FULL"' in out and '"num_paths":4' in out and 'Set 1: {ε, "CC"} [degenerate]' in out
    cli.main(["random", "-l", "60", "--variability", "0.1", "--variant-length-max", "3", "-o", str(tmp_path / "r.eds")])
    assert (tmp_path / "r.eds").read_text().count(",") >= 6


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("#h\n1\t5\t.\tA\tC\n1\tx\t.\tA\tC\n1\t6\t.\tA\t<INV>\n")
    counts = vcf_lines.skip_counts(vcf_lines.read_lines(spark, str(tmp_path / "in")))
    running = counts.writeStream.outputMode("complete").format("memory").queryName("skips").start()
    running.processAllAvailable()
    running.stop()
    assert {r.status: r.n for r in spark.table("skips").groupBy("status").agg(F.sum("n").alias("n")).collect()} == {"HEADER": 1, "NONE": 1, "MALFORMED": 1, "UNSUPPORTED_SV": 1}

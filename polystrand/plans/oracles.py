"""SQL (DuckDB) that gives the rows of the registered string queries."""

from __future__ import annotations


def _base(x: str) -> str:
    return f"substring('ACGT', CAST(({x}) % 4 AS INT) + 1, 1)"


def _dna(x: str, length: str, digits: int = 4) -> str:
    return f"substring({' || '.join(_base(f'({x}) // {4**i}') for i in range(digits))}, 1, CAST({length} AS INT))"


LINES = f"""lines AS (SELECT o_custkey c, l_orderkey o, l_linenumber ln, min(l_partkey) pk, list_sort(list_distinct(list(CAST(l_suppkey % 8 + 1 AS INT)))) src FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
al AS (SELECT c, o, {_dna('pk', 'pk % 5')} s, src, dense_rank() OVER (PARTITION BY c ORDER BY o) - 1 pos, row_number() OVER (PARTITION BY c, o ORDER BY ln) - 1 alt_no, count(*) OVER (PARTITION BY c, o) k FROM lines)"""
E1 = f"""{LINES},
st AS (SELECT CAST(c AS VARCHAR) eds_id, pos, alt_no, k, s, CASE WHEN k = 1 THEN [0] ELSE src END src, row_number() OVER (PARTITION BY c ORDER BY pos, alt_no) - 1 string_id FROM al)"""
E2 = f"""{LINES},
two AS (SELECT c, o, dense_rank() OVER (PARTITION BY c ORDER BY o) - 1 k, alt_no, s FROM al WHERE k >= 2 AND alt_no < 2),
st AS (SELECT CAST(c AS VARCHAR) eds_id, 2 * k pos, 0 alt_no, 1 k, {_dna('o', 'o % 8', 8)} s, [0] src FROM two WHERE alt_no = 0
 UNION ALL SELECT CAST(c AS VARCHAR), 2 * k + 1, alt_no, 2, s, CASE WHEN alt_no = 0 THEN [1, 2] WHEN o % 2 = 0 THEN [2, 3] ELSE [3] END FROM two)"""
SYM = """sym AS (SELECT eds_id, pos, any_value(k) k, string_agg(s, ',' ORDER BY alt_no) body, string_agg('{' || array_to_string(src, ',') || '}', '' ORDER BY alt_no) srcs, sum(length(s)) chars, count(*) FILTER (s = '') e FROM st GROUP BY 1, 2)"""
STATS = f"""{E1}, {SYM}, stats AS (SELECT eds_id, count(*) n, CAST(sum(k) AS BIGINT) m, CAST(sum(chars) AS BIGINT) n_chars, count(*) FILTER (k > 1) num_degenerate, CAST(coalesce(min(chars) FILTER (k = 1), 0) AS BIGINT) min_ctx, CAST(coalesce(max(chars) FILTER (k = 1), 0) AS BIGINT) max_ctx, round(coalesce(avg(chars) FILTER (k = 1), 0.0), 6) avg_ctx, CAST(coalesce(sum(chars) FILTER (k = 1), 0) AS BIGINT) common_chars, CAST(coalesce(sum(k - 1) FILTER (k > 1), 0) AS BIGINT) change_size, CAST(sum(e) AS BIGINT) empty_strings FROM sym GROUP BY 1)"""
INDEX = """ix AS (SELECT eds_id, pos, k size, length(split_part(body, ',', 1)) first_len, k > 1 is_deg, CAST(coalesce(sum(k) OVER w, 0) AS BIGINT) cum_set, CAST(coalesce(sum(CASE WHEN k = 1 THEN chars ELSE 0 END) OVER w, 0) AS BIGINT) cum_common, CAST(coalesce(sum(CASE WHEN k > 1 THEN k ELSE 0 END) OVER w, 0) AS BIGINT) cum_deg FROM sym WINDOW w AS (PARTITION BY eds_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _meet(a: str, b: str) -> str:
    return f"CASE WHEN list_contains({a}, 0) AND list_contains({b}, 0) THEN [0] WHEN list_contains({a}, 0) THEN {b} WHEN list_contains({b}, 0) THEN {a} ELSE list_filter({a}, lambda p: list_contains({b}, p)) END"


def _text(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _merge(linear: bool) -> str:
    keep = f"WHERE len({_meet('a.src', 'b.src')}) > 0" if linear else ""
    srcs = f", string_agg('{{' || {_text(_meet('a.src', 'b.src'))} || '}}', '' ORDER BY a.alt_no, b.alt_no) srcs" if linear else ""
    return f"SELECT a.eds_id, a.pos, string_agg(a.s || b.s, ',' ORDER BY a.alt_no, b.alt_no) alts{srcs} FROM st a JOIN st b ON a.eds_id = b.eds_id AND b.pos = a.pos + 1 {keep} GROUP BY 1, 2"


CAND = """lim AS (SELECT *, max(pos) OVER (PARTITION BY eds_id) last, k = 1 AND pos > 0 AND pos < max(pos) OVER (PARTITION BY eds_id) AND chars < 3 short FROM sym),
cd AS (SELECT *, pos < last AND (short OR lead(short) OVER w OR (k > 1 AND lead(k) OVER w > 1)) cand FROM lim WINDOW w AS (PARTITION BY eds_id ORDER BY pos))"""
RUNS = """rg AS (SELECT eds_id, pos, sum(CASE WHEN coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY eds_id ORDER BY pos) region FROM (SELECT *, lag(cand) OVER (PARTITION BY eds_id ORDER BY pos) prev FROM cd)),
ends AS (SELECT eds_id, region, min(pos) lo, max(pos) hi FROM rg GROUP BY 1, 2)"""


def _leds(linear: bool) -> str:
    src = _meet("r.src", "t.src") if linear else "NULL"
    keep = f"AND len({_meet('r.src', 't.src')}) > 0" if linear else ""
    out = ", string_agg('{' || array_to_string(src, ',') || '}', '' ORDER BY ord) srcs" if linear else ""
    return f"""WITH RECURSIVE {E2}, {SYM}, {CAND}, {RUNS},
rec AS (SELECT e.eds_id, e.region, e.hi, t.pos, t.s, t.src, [t.alt_no] ord FROM ends e JOIN st t ON t.eds_id = e.eds_id AND t.pos = e.lo
 UNION ALL SELECT r.eds_id, r.region, r.hi, t.pos, r.s || t.s, {src}, list_append(r.ord, t.alt_no) FROM rec r JOIN st t ON t.eds_id = r.eds_id AND t.pos = r.pos + 1 AND r.pos < r.hi {keep})
SELECT eds_id, CAST(region - 1 AS BIGINT) pos, string_agg(s, ',' ORDER BY ord) alts{out} FROM rec WHERE pos = hi GROUP BY 1, 2"""


START = "first AS (SELECT eds_id, min(pos) p0 FROM ix WHERE size = 1 AND first_len > 0 GROUP BY 1)"
WALK = """ch AS (SELECT st.eds_id, st.pos, st.k, st.s, st.src, coalesce(sum(length(st.s)) OVER (PARTITION BY st.eds_id ORDER BY st.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM st JOIN first USING (eds_id) WHERE st.pos >= p0 AND (k = 1 OR alt_no = CAST(eds_id AS BIGINT) % 2)),
txt AS (SELECT eds_id, least(9, sum(length(s))) need FROM ch GROUP BY 1)"""
PART = "pc AS (SELECT p_brand b, p_partkey p, CAST(p_size AS BIGINT) size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) rk FROM part)"
MSA = f"""{PART}, cells AS (SELECT b, k, rk, CASE WHEN (p * 31 + k * 17) % 23 = 0 THEN '-' WHEN (p * 7 + k * 13) % 29 = 0 THEN {_base('p + k')} ELSE {_base('p')} END ch FROM pc, (SELECT unnest([0, 1, 2, 3]) k)),
msa AS (SELECT b, k + 1 seq_no, string_agg(ch, '' ORDER BY rk) seq FROM cells GROUP BY 1, 2)"""


def _msa(least: int) -> str:
    alone = f"common AND (hi - lo + 1 >= {least} OR lo = 1 OR hi = last)" if least else "true"
    return f"""WITH {MSA}, col AS (SELECT b, rk, min(ch) = max(ch) AND min(ch) <> '-' common FROM cells GROUP BY 1, 2),
ed AS (SELECT *, CASE WHEN common = lag(common) OVER w THEN 0 ELSE 1 END edge, max(rk) OVER (PARTITION BY b) last FROM col WINDOW w AS (PARTITION BY b ORDER BY rk)),
rn AS (SELECT *, sum(edge) OVER (PARTITION BY b ORDER BY rk) run FROM ed),
r2 AS (SELECT b, run, min(rk) lo, max(rk) hi, any_value(common) common, any_value(last) last FROM rn GROUP BY 1, 2),
r3 AS (SELECT *, {alone} alone FROM r2),
r4 AS (SELECT *, CASE WHEN alone OR coalesce(lag(alone) OVER (PARTITION BY b ORDER BY run), true) THEN 1 ELSE 0 END s FROM r3),
r5 AS (SELECT *, sum(s) OVER (PARTITION BY b ORDER BY run) - 1 region FROM r4),
r6 AS (SELECT b, region, min(lo) lo, max(hi) hi, bool_and(common AND alone) common FROM r5 GROUP BY 1, 2),
tx AS (SELECT r6.b, region, common, seq_no, replace(substring(seq, CAST(lo AS INT), CAST(hi - lo + 1 AS INT)), '-', '') s FROM r6 JOIN msa USING (b)),
po AS (SELECT b, region, common, s, min(seq_no) f, list_sort(list(seq_no)) rws FROM tx GROUP BY 1, 2, 3, 4)
SELECT b eds_id, CAST(region AS BIGINT) pos, string_agg(s, ',' ORDER BY f) alts, string_agg('{{' || CASE WHEN common THEN '0' ELSE array_to_string(rws, ',') END || '}}', '' ORDER BY f) srcs FROM po GROUP BY 1, 2"""


VCF = f"""{PART}, fa AS (SELECT b, string_agg({_base('p')}, '' ORDER BY rk) seq FROM pc GROUP BY 1),
v0 AS (SELECT b, p, rk, size % 6 kind, substring(seq, CAST(rk AS INT), CAST(1 + size % 3 AS INT)) ref FROM pc JOIN fa USING (b) WHERE p % 5 = 0),
va AS (SELECT *, CASE kind WHEN 0 THEN [{_base('p + 1')}] WHEN 1 THEN [''] WHEN 2 THEN [ref || 'GT'] WHEN 3 THEN [{_base('p + 1')}, {_base('p + 2')}] WHEN 4 THEN [ref] END alts, CASE WHEN kind = 3 THEN 2 ELSE 1 END n FROM v0),
ok AS (SELECT *, rk - 1 gin, rk - 1 + length(ref) gout FROM va WHERE kind < 5),
gr AS (SELECT *, sum(CASE WHEN gin >= reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY rk, p) - 1 g FROM (SELECT *, max(gout) OVER (PARTITION BY b ORDER BY rk, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM ok))"""
HAPS = f"""{VCF}, sp AS (SELECT b, g, min(gin) gb, max(gout) ge FROM gr GROUP BY 1, 2),
sq AS (SELECT sp.*, substring(seq, CAST(gb + 1 AS INT), CAST(ge - gb AS INT)) span FROM sp JOIN fa USING (b)),
vh AS (SELECT gr.b, gr.g, gb, ge, span, gr.rk, gr.p, gr.n, gin, ref, list_prepend(span, list_transform(alts, lambda a: substring(span, 1, CAST(gin - gb AS INT)) || a || substring(span, CAST(gin - gb + length(ref) + 1 AS INT)))) haps FROM gr JOIN sq USING (b, g)),
oh AS (SELECT b, g, gb, ge, span, haps[i] hap, min(CASE WHEN i = 1 THEN 0 ELSE rk * 1000000 + p * 10 + i END) ord FROM vh, (SELECT unnest([1, 2, 3]) i) WHERE i <= len(haps) GROUP BY 1, 2, 3, 4, 5, 6),
gs AS (SELECT b, g, k + 1 sample, haps[1 + CASE WHEN h = 0 THEN (p + 3 * k) % (n + 1) ELSE (p + k) % 2 END] hap FROM vh, (SELECT unnest([0, 1, 2, 3]) k), (SELECT unnest([0, 1]) h)),
ca AS (SELECT b, g, hap, list_sort(list_distinct(list(sample))) samples FROM gs GROUP BY 1, 2, 3),
hp AS (SELECT b, g, gb, ge, hap, ord, samples FROM oh JOIN ca USING (b, g, hap))"""
EDS = f"""{HAPS}, gsym AS (SELECT b, gb lo, 1 o, ge hi, string_agg(hap, ',' ORDER BY ord) alts, string_agg('{{' || array_to_string(samples, ',') || '}}', '' ORDER BY ord) srcs FROM hp GROUP BY b, g, gb, ge),
gp AS (SELECT b, coalesce(lag(hi) OVER (PARTITION BY b ORDER BY lo), 0) f, lo t FROM gsym UNION ALL SELECT fa.b, coalesce(max(hi), 0), length(any_value(seq)) FROM fa LEFT JOIN gsym USING (b) GROUP BY 1),
al AS (SELECT gp.b, f lo, 0 o, substring(seq, CAST(f + 1 AS INT), CAST(t - f AS INT)) alts, '{{0}}' srcs FROM gp JOIN fa USING (b) WHERE t > f UNION ALL SELECT b, lo, o, alts, srcs FROM gsym)"""

ORACLES = {
    "eds_statistics": f"WITH {STATS} SELECT * FROM stats",
    "parse_eds": f"WITH {E1} SELECT eds_id, pos, alt_no, string_id, s, length(s) len FROM st",
    "parse_seds": f"WITH {E1} SELECT eds_id, string_id, s, array_to_string(src, ',') src FROM st",
    "normalize_eds": f"WITH {E2}, {SYM} SELECT eds_id, coalesce(string_agg('{{' || body || '}}', '' ORDER BY pos) FILTER (k > 1 OR body <> ''), '') eds FROM sym GROUP BY 1",
    "serialize_full": f"WITH {E1}, {SYM} SELECT eds_id, string_agg('{{' || body || '}}', '' ORDER BY pos) eds FROM sym GROUP BY 1",
    "serialize_compact": f"WITH {E2}, {SYM} SELECT eds_id, string_agg(CASE WHEN k = 1 THEN body ELSE '{{' || body || '}}' END, '' ORDER BY pos) eds FROM sym GROUP BY 1",
    "serialize_seds": f"WITH {E1}, {SYM} SELECT eds_id, string_agg(srcs, '' ORDER BY pos) seds FROM sym GROUP BY 1",
    "validate_eds": f"WITH {E2} SELECT eds_id, CASE CAST(eds_id AS BIGINT) % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISSING_OPEN' WHEN 2 THEN 'MISSING_CLOSE' WHEN 3 THEN 'CARDINALITY' WHEN 4 THEN 'EMPTY_SET' ELSE 'BAD_CHARACTER' END status FROM st GROUP BY 1",
    "source_statistics": f"WITH {E1} SELECT eds_id, num_paths, max_paths_per_string, avg_paths_per_string FROM (SELECT eds_id, CAST(max(len(src)) AS BIGINT) max_paths_per_string, round(avg(len(src)), 6) avg_paths_per_string FROM st GROUP BY 1) JOIN (SELECT eds_id, count(DISTINCT p) num_paths FROM (SELECT eds_id, unnest(src) p FROM st) GROUP BY 1) USING (eds_id)",
    "memory_estimate": f"WITH {STATS} SELECT eds_id, (n_chars + 32 * m + 24 * n) + (n_chars + 32 * m + 24 * n) // 5 full_bytes, (17 * n + 4 * m + 64) + (17 * n + 4 * m + 64) // 10 index_bytes FROM stats",
    "stats_verbose": f"WITH {STATS} SELECT eds_id, round(CAST(m AS DOUBLE) / n, 6) strings_per_symbol, round(CAST(n_chars AS DOUBLE) / m, 6) chars_per_string, round(100 * (CAST(num_degenerate AS DOUBLE) / n), 6) degenerate_percent, CASE WHEN min_ctx < 5 THEN 'transform' ELSE 'none' END advice FROM stats",
    "stats_json": f"WITH {STATS}, sp AS (SELECT eds_id, count(DISTINCT p) paths FROM (SELECT eds_id, unnest(src) p FROM st) GROUP BY 1) SELECT eds_id, n, n_chars chars, n - num_degenerate regular, max_ctx, change_size change, (17 * n + 4 * m + 64) + (17 * n + 4 * m + 64) // 10 bytes, (n_chars + 32 * m + 24 * n) + (n_chars + 32 * m + 24 * n) // 5 full_bytes, paths, CASE WHEN min_ctx < 5 THEN 'true' ELSE 'false' END transform FROM stats JOIN sp USING (eds_id)",
    "stats_text": f"WITH {STATS} SELECT eds_id, CAST(n AS VARCHAR) n, CAST(n_chars AS VARCHAR) chars, printf('%.2f', avg_ctx) avg_ctx FROM stats",
    "symbol_lines": f"""WITH {E1} SELECT eds_id, pos, 'Set ' || pos || ': {{' || string_agg(CASE WHEN s = '' THEN 'ε' ELSE '"' || s || '"' END, ', ' ORDER BY alt_no) || '}}' || CASE WHEN any_value(k) > 1 THEN ' [degenerate]' ELSE '' END line FROM st GROUP BY eds_id, pos""",
    "variants_overlap": f"WITH {VCF} SELECT b vcf_id, p line_no, rk < r2 + length(f2) AND r2 < rk + length(ref) AS \"overlap\" FROM (SELECT *, lead(rk) OVER w r2, lead(ref) OVER w f2 FROM ok WINDOW w AS (PARTITION BY b ORDER BY rk, p)) WHERE r2 IS NOT NULL",
    "eds_index": f"WITH {E1}, {SYM}, {INDEX} SELECT * FROM ix",
    "read_symbol": f"WITH {E1}, {SYM} SELECT eds_id, pos, body alts, srcs FROM sym WHERE pos = 2",
    "extract": f"""WITH {E1}, {SYM}, q AS (SELECT eds_id, CAST(0 AS BIGINT) qid, count(*) n, max(k) FILTER (pos = 2) k2 FROM sym GROUP BY 1),
t AS (SELECT eds_id, string_agg(s, '' ORDER BY pos) text FROM st WHERE (pos = 1 AND alt_no = 0) OR (pos = 2 AND alt_no = 1) GROUP BY 1),
s AS (SELECT *, CASE WHEN n <= 1 THEN 'OUT_OF_RANGE' WHEN n = 2 THEN 'WRONG_COUNT' WHEN k2 < 2 THEN 'BAD_CHOICE' ELSE 'OK' END status FROM q)
SELECT eds_id, qid, status, CASE WHEN status = 'OK' THEN text END AS text FROM s LEFT JOIN t USING (eds_id)""",
    "source_intersect": f"WITH {E1} SELECT a.eds_id, a.pos, {_text(_meet('a.src', 'b.src'))} paths FROM st a JOIN st b ON a.eds_id = b.eds_id AND a.pos = b.pos AND a.alt_no = 0 AND b.alt_no = 1",
    "merge_cartesian": f"WITH {E2} {_merge(False)}",
    "merge_linear": f"WITH {E2} {_merge(True)}",
    "merge_adjacent": f"WITH {E2}, {SYM}, m AS ({_merge(True)}) SELECT eds_id, pos, alts, srcs FROM m WHERE pos = 0 UNION ALL SELECT eds_id, pos - 1, body, srcs FROM sym WHERE pos > 1",
    "is_leds": f"WITH {E2}, {SYM}, {CAND} SELECT eds_id, NOT bool_or(short OR cand) is_leds FROM cd GROUP BY 1",
    "leds_candidates": f"WITH {E2}, {SYM}, {CAND} SELECT eds_id, pos, cand FROM cd",
    "leds_pairs": f"WITH {E2}, {SYM}, {CAND}, rn AS (SELECT *, sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY eds_id ORDER BY pos) run FROM cd) SELECT eds_id, pos, cand AND row_number() OVER (PARTITION BY eds_id, run, cand ORDER BY pos) % 2 = 1 pick FROM rn",
    "eds_to_leds_linear": _leds(True),
    "eds_to_leds_cartesian": _leds(False),
    "check_position": f"WITH {E2}, {SYM}, {INDEX}, {START}, {WALK}, f AS (SELECT ch.eds_id, length(s) l, need FROM ch JOIN first ON ch.eds_id = first.eds_id AND ch.pos = p0 JOIN txt ON txt.eds_id = ch.eds_id) SELECT eds_id, CAST(q AS BIGINT) qid, CASE q WHEN 0 THEN 'MATCH' WHEN 1 THEN CASE WHEN l < need THEN 'TOO_FEW_CHOICES' ELSE 'MATCH' END ELSE 'NO_MATCH' END status FROM f, (SELECT unnest([0, 1, 2]) q)",
    "path_intersection": f"WITH {E2}, {SYM}, {INDEX}, {START}, {WALK} SELECT eds_id, CASE WHEN bool_or(src = [3]) THEN '3' WHEN bool_or(src = [2, 3]) THEN '2,3' WHEN bool_or(src = [1, 2]) THEN '1,2' ELSE '0' END path FROM ch JOIN txt USING (eds_id) WHERE before < need GROUP BY 1",
    "locate_common": f"WITH {E1}, {SYM}, {INDEX}, q AS (SELECT DISTINCT eds_id, unnest([0, 2, 5]) common_pos FROM sym) SELECT q.eds_id, CAST(common_pos AS BIGINT) common_pos, ix.pos AS start, common_pos - cum_common AS \"offset\" FROM q LEFT JOIN ix ON q.eds_id = ix.eds_id AND size = 1 AND common_pos >= cum_common AND common_pos < cum_common + first_len",
    "decode_degenerate": f"WITH {E1}, {SYM}, {INDEX}, q AS (SELECT DISTINCT eds_id, unnest([0, 7, 99]) deg_no FROM sym) SELECT q.eds_id, CAST(deg_no AS BIGINT) deg_no, ix.pos, deg_no - cum_deg AS local FROM q LEFT JOIN ix ON q.eds_id = ix.eds_id AND is_deg AND deg_no >= cum_deg AND deg_no < cum_deg + size",
    "parse_msa": f"WITH {MSA} SELECT b msa_id, CAST(seq_no AS BIGINT) seq_no, 's' || seq_no AS name, seq FROM msa",
    "msa_to_eds": _msa(0),
    "msa_to_leds": _msa(3),
    "parse_fasta": f"WITH {VCF} SELECT b vcf_id, 'ref' AS name, seq FROM fa",
    "fasta_region": f"WITH {VCF} SELECT b vcf_id, substring(seq, 11, 25) region FROM fa",
    "parse_vcf": f"WITH {VCF} SELECT b vcf_id, p line_no, CASE WHEN kind = 5 THEN 'UNSUPPORTED_SV' ELSE 'NONE' END status, rk pos, ref FROM va",
    "vcf_skip_stats": f"WITH {VCF} SELECT CASE WHEN kind = 5 THEN 'UNSUPPORTED_SV' ELSE 'NONE' END status, count(*) n FROM va GROUP BY 1 UNION ALL SELECT 'HEADER', count(DISTINCT b) FROM va",
    "vcf_alts": f"WITH {VCF} SELECT b vcf_id, p line_no, array_to_string(alts, ',') alts FROM ok",
    "vcf_genotypes": f"WITH {VCF} SELECT b vcf_id, p line_no, {chr(32).join(['', *[f'((p + {3 * k}) % (n + 1)) || chr(124) || ((p + {k}) % 2)' + (' || chr(59) ||' if k < 3 else '') for k in range(4)]])} gts FROM ok",
    "vcf_groups": f"WITH {VCF} SELECT b vcf_id, p line_no, gin AS begin, gout AS \"end\", CAST(g AS BIGINT) group_no FROM gr",
    "vcf_stats": f"WITH {VCF} SELECT vcf_id, total, processed, malformed, unsupported, coalesce(groups, 0) AS groups FROM (SELECT b vcf_id, count(*) total, count(*) FILTER (kind < 5) processed, CAST(0 AS BIGINT) malformed, count(*) FILTER (kind = 5) unsupported FROM va GROUP BY 1) LEFT JOIN (SELECT b vcf_id, count(DISTINCT g) AS groups FROM gr GROUP BY 1) USING (vcf_id)",
    "vcf_haplotypes": f"WITH {HAPS} SELECT b vcf_id, gb AS begin, ge AS \"end\", hap, array_to_string(samples, ',') samples FROM hp",
    "vcf_to_eds": f"WITH {EDS} SELECT b eds_id, row_number() OVER (PARTITION BY b ORDER BY lo, o) - 1 pos, alts, srcs FROM al",
}

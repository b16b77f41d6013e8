"""DuckDB SQL of the registered queries, from the same tables and definitions."""

from __future__ import annotations

from .functions.superpose import NEWTON_STEPS
from .functions.text import MASSES
from .queries import BINS, GROUP

MEMBER = "member AS (SELECT l_orderkey AS structure_id, l_partkey AS header, l_linenumber AS pos FROM lineitem)"
METRIC = """metric AS (
  SELECT o_orderkey AS structure_id, o_totalprice AS metric1, metric2, plddt, seq_count, CAST(year(o_orderdate) AS INTEGER) AS iteration,
         CAST(o_orderkey % 3 AS INTEGER) AS round, CASE WHEN o_orderkey % 2 = 0 THEN 'prediction' ELSE 'control' END AS arm
  FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS metric2, round(2 * avg(l_quantity), 6) AS plddt, count(*) AS seq_count
                    FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
SOURCE = "source AS (SELECT p_partkey AS pos, p_partkey AS header, concat_ws('-', upper(p_brand), p_type) AS seq FROM part)"
OTHER = "source AS (SELECT p_partkey AS pos, p_partkey AS header, concat_ws('-', upper(p_brand), p_type) AS seq FROM part WHERE p_partkey % 5 <> 0)"
MSA = "msa AS (SELECT doc_id AS pos, '>d' || doc_id || ' ' || source AS line, text AS seq FROM documents)"
CHOSEN = "chosen AS (SELECT p_partkey AS header, -p_partkey AS pos FROM part WHERE p_retailprice > 950)"


def _edges(lo: str, hi: str, n: int) -> str:
    return f"list_transform(range({n} + 1), lambda k: CASE WHEN k = {n} THEN CAST({hi} AS DOUBLE) ELSE k * ((CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE)) / {float(n)}) + CAST({lo} AS DOUBLE) END)"


def _digitize(value: str, edges: str) -> str:
    return f"len(list_filter({edges}, lambda e: e <= {value}))"


def _even(name: str, n: int) -> str:
    return f"CAST({_digitize(name, _edges(f'lo_{name}', f'hi_{name}', n))} - 1 AS INTEGER)"


def _bounded(*names: str, where: str = "true") -> str:
    """Rows of metric with the bounds of the named metrics beside them."""
    limits = ", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in names)
    return f"(SELECT * FROM metric, (SELECT {limits} FROM metric WHERE {where}) WHERE {where})"


FOCUSED = f"CAST(CASE WHEN metric1 < 50000 THEN 0 WHEN metric1 > 300000 THEN {BINS + 1} ELSE {_digitize('metric1', _edges('50000', '300000', BINS))} END AS INTEGER)"


def _vote(binned: str, bins: int = 1, where: str = "true", source: str = SOURCE) -> str:
    names = [f"bin_{i}" for i in range(1, bins + 1)]
    out = ["Bin_Assignment"] if bins == 1 else [f"Bin_Assignment_{i}" for i in range(1, bins + 1)]
    cols = ", ".join(names)
    return f"""WITH {MEMBER}, {METRIC}, {source}, binned AS ({binned}),
counts AS (SELECT m.header, {cols}, count(*) AS n FROM member m JOIN binned b USING (structure_id) WHERE m.header IN (SELECT header FROM source) GROUP BY m.header, {cols}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY n DESC, {cols}) AS k, sum(n) OVER (PARTITION BY header) AS total FROM counts),
result AS (SELECT header AS Sequence_Header, {", ".join(f"{a} AS {b}" for a, b in zip(names, out, strict=True))}, n AS Vote_Count, CAST(total AS BIGINT) AS Total_Votes FROM ranked WHERE k = 1 AND {where})"""


VOTE_FOCUSED = _vote(f"SELECT structure_id, {FOCUSED} AS bin_1 FROM metric")
VOTES = f"""WITH {MEMBER}, {METRIC}, {SOURCE}, binned AS (SELECT structure_id, {FOCUSED} AS bin FROM metric),
votes AS (SELECT m.header, bin FROM member m JOIN binned USING (structure_id) WHERE m.header IN (SELECT header FROM source))"""


def _key(seed: str, shuffle: str, header: str = "header") -> str:
    return f"md5({seed} || '|' || {shuffle} || '|' || {header})"


def _groups(size: int, seed: str = "'5'") -> str:
    return f"""{SOURCE},
ranked AS (SELECT header, row_number() OVER (ORDER BY {_key(seed, "'0'")}, header) AS rank, count(*) OVER () AS n FROM source),
groups AS (SELECT CAST(least((rank - 1) // {size} + 1, greatest(1, n // {size})) AS INTEGER) AS "group", header FROM ranked)"""


def _splits(size: int, rounds: str) -> str:
    seed = "CAST(seed AS VARCHAR)"
    return f"""WITH {SOURCE}, rounds AS ({rounds}),
ranked AS (SELECT round, seed, header, row_number() OVER (PARTITION BY round ORDER BY {_key(seed, "'0'")}, header) AS rank, count(*) OVER (PARTITION BY round) AS n FROM source, rounds),
groups AS (SELECT round, seed, least((rank - 1) // {size} + 1, greatest(1, n // {size})) AS g, header FROM ranked),
split AS (SELECT a.round, a.seed, s.sampling, a.header FROM groups a JOIN (SELECT DISTINCT round, g AS sampling FROM groups) s ON a.round = s.round AND a.g <> s.sampling),
again AS (SELECT *, row_number() OVER (PARTITION BY round, sampling ORDER BY {_key(seed, "CAST(sampling AS VARCHAR)")}, header) AS rank, count(*) OVER (PARTITION BY round, sampling) AS n FROM split)
SELECT round, CAST(sampling AS INTEGER) AS sampling, CAST(least((rank - 1) // {size} + 1, greatest(1, n // {size})) AS INTEGER) AS "group", rank, header FROM again"""


CA = """ca AS (
  SELECT vec_id AS structure_id, CAST(k AS INTEGER) AS res_seq, CAST(embedding[k * 3 - 2] AS DOUBLE) AS x, CAST(embedding[k * 3 - 1] AS DOUBLE) AS y, CAST(embedding[k * 3] AS DOUBLE) AS z,
         CAST(vec_id % 100 AS DOUBLE) AS b_factor
  FROM embeddings, range(1, 22) r(k))"""
BACKBONE = CA + """, bb AS (
  SELECT structure_id, res_seq AS line_no, CAST((res_seq - 1) // 3 + 1 AS INTEGER) AS res_seq, ['N', 'CA', 'C'][(res_seq - 1) % 3 + 1] AS atom_name,
         ['N', 'C', 'C'][(res_seq - 1) % 3 + 1] AS element, ['GLY', 'ALA', 'SER'][structure_id % 3 + 1] AS res_name, x, y, z, b_factor FROM ca)"""


def _center(name: str, where: str) -> str:
    mass = f"CASE WHEN {where} THEN CASE element WHEN 'N' THEN {MASSES['N']} ELSE {MASSES['C']} END END"
    return ", ".join(f"sum({a} * {mass}) / sum({mass}) AS {name}_{a}" for a in "xyz")


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _minor(m: list[list[str]], row: int, col: int) -> list[list[str]]:
    return [[m[r][c] for c in range(4) if c != col] for r in range(4) if r != row]


def _pose(pairs: str) -> str:
    """CTEs sums, rooted and turned from pairs (structure_id, tx.. rz): root and quaternion of each structure."""
    cross = ", ".join(f"sum(t{a} * r{b}) - sum(t{a}) * sum(r{b}) / count(*) AS s{a}{b}" for a in "xyz" for b in "xyz")
    spread = " + ".join(f"(sum({p}{a} * {p}{a}) - sum({p}{a}) * sum({p}{a}) / count(*))" for p in "tr" for a in "xyz")
    means = ", ".join(f"avg({p}{a}) AS m{p}{a}" for p in "tr" for a in "xyz")
    k = [["k00", "k01", "k02", "k03"], ["k01", "k11", "k12", "k13"], ["k02", "k12", "k22", "k23"], ["k03", "k13", "k23", "k33"]]
    c0 = " ".join(f"{'+' if c % 2 == 0 else '-'} {k[0][c]} * {_det3(_minor(k, 0, c))}" for c in range(4))
    s = [[f"s{a}{b}" for b in "xyz"] for a in "xyz"]
    m = [[f"({k[r][c]} - root)" if r == c else k[r][c] for c in range(4)] for r in range(4)]
    adj = [[f"{'' if (r + c) % 2 == 0 else '-'}{_det3(_minor(m, c, r))}" for r in range(4)] for c in range(4)]
    columns = ", ".join(f"[{', '.join(col)}]" for col in adj)
    return f"""
sums AS (SELECT structure_id, count(*) AS n, {means}, {cross}, ({spread}) / 2 AS e0 FROM {pairs} GROUP BY 1),
kmat AS (SELECT *, sxx + syy + szz AS k00, syz - szy AS k01, szx - sxz AS k02, sxy - syx AS k03, sxx - syy - szz AS k11, sxy + syx AS k12, szx + sxz AS k13,
                syy - sxx - szz AS k22, syz + szy AS k23, szz - sxx - syy AS k33 FROM sums),
poly AS (SELECT *, -2.0 * ({" + ".join(f"{x} * {x}" for row in s for x in row)}) AS c2, -8.0 * {_det3(s)} AS c1, 0.0 {c0} AS c0 FROM kmat),
rooted AS (SELECT *, list_reduce(list_prepend(e0, list_transform(range({NEWTON_STEPS}), lambda i: 0.0)),
    lambda x, i: x - coalesce((((x * x + c2) * x + c1) * x + c0) / nullif((4.0 * x * x + 2.0 * c2) * x + c1, 0), 0)) AS root FROM poly),
cols AS (SELECT *, unnest([{columns}]) AS q0 FROM rooted),
best AS (SELECT structure_id, arg_max(q0, list_sum(list_transform(q0, lambda v: v * v))) AS q0 FROM cols GROUP BY 1),
turned AS (SELECT r.*, list_transform(b.q0, lambda v: v / sqrt(list_sum(list_transform(b.q0, lambda u: u * u)))) AS q FROM rooted r JOIN best b USING (structure_id))"""


_ROTATION = {
    "x": ("q[1]*q[1] + q[2]*q[2] - q[3]*q[3] - q[4]*q[4]", "2*(q[2]*q[3] - q[1]*q[4])", "2*(q[2]*q[4] + q[1]*q[3])"),
    "y": ("2*(q[2]*q[3] + q[1]*q[4])", "q[1]*q[1] - q[2]*q[2] + q[3]*q[3] - q[4]*q[4]", "2*(q[3]*q[4] - q[1]*q[2])"),
    "z": ("2*(q[2]*q[4] - q[1]*q[3])", "2*(q[3]*q[4] + q[1]*q[2])", "q[1]*q[1] - q[2]*q[2] - q[3]*q[3] + q[4]*q[4]"),
}


def _moved(pairs: str) -> str:
    """CTE moved: squared distance of each pair after the turn."""
    parts = [f"({' + '.join(f'({r}) * (t{b} - mt{b})' for r, b in zip(rows, 'xyz', strict=True))} + mr{a} - r{a})" for a, rows in _ROTATION.items()]
    return f"moved AS (SELECT p.structure_id, {' + '.join(f'{x} * {x}' for x in parts)} AS d2 FROM {pairs} p JOIN turned USING (structure_id))"


def _pairs(name: str, table: str, key: str, where: str = "true") -> str:
    return f"{name} AS (SELECT t.structure_id, t.res_seq, t.x AS tx, t.y AS ty, t.z AS tz, r.x AS rx, r.y AS ry, r.z AS rz FROM {table} t JOIN (SELECT * FROM {table} WHERE structure_id = 0) r USING ({key}) WHERE {where})"


def _norm(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}_{x} - {b}_{x}) * ({a}_{x} - {b}_{x})" for x in "xyz") + ")"


_DOT = " + ".join(f"(a_{x} - h_{x}) * (b_{x} - h_{x})" for x in "xyz")
_ANGLE = f"degrees(acos(greatest(-1.0, least(1.0, ({_DOT}) / ({_norm('a', 'h')} * {_norm('b', 'h')})))))"
_HIST_EDGES = f"[{', '.join(str(i * 2.5) for i in range(41))}]"
_PATHS = """paths AS (SELECT o_orderkey AS structure_id, 'run/round_' || o_orderkey % 3 || '/02_sampling/sampling_' || o_orderkey % 7 || CASE WHEN o_orderkey % 10 = 0 THEN '/non_a3m' ELSE '' END
  || '/group_' || o_orderkey % 11 || '_unrelaxed_rank_001_model_1' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_seed_' || lpad(CAST(o_orderkey % 8 AS VARCHAR), 3, '0') END || '.pdb' AS path FROM orders)"""
_ENTRIES = "entries AS (SELECT structure_id, 'p' || header AS header, 'S' || lpad(CAST(header % 13 AS VARCHAR), 2, '0') AS seq, structure_id * 10 + pos AS pos FROM member)"
#: Digits go in the strict cleaning of sequences.
_DISTINCT = "SELECT min(pos) AS pos, header, 'S' AS seq FROM {} GROUP BY header"
_ARMS = f"""WITH {METRIC}, {_PATHS}, arms AS (SELECT arm, 'bin_' || structure_id % CASE WHEN arm = 'control' THEN 9 ELSE 8 END AS bin_label, path, metric1, metric2, plddt FROM metric JOIN paths USING (structure_id))"""

ORACLE_SQL = {
    "vote_1d": _vote(f"SELECT structure_id, {_even('metric1', BINS)} AS bin_1 FROM {_bounded('metric1')}") + " SELECT * FROM result",
    "vote_focused": VOTE_FOCUSED + " SELECT * FROM result",
    "vote_threshold": _vote(f"SELECT structure_id, {_even('metric1', BINS)} AS bin_1 FROM {_bounded('metric1', where='plddt > 40')}", where="n / total >= 0.15", source=OTHER) + " SELECT * FROM result",
    "vote_2d": _vote(f"SELECT structure_id, {_even('metric1', 10)} AS bin_1, {_even('metric2', 10)} AS bin_2 FROM {_bounded('metric1', 'metric2')}", 2) + " SELECT * FROM result",
    "vote_3d": _vote(f"SELECT structure_id, {_even('metric1', 10)} AS bin_1, {_even('metric2', 10)} AS bin_2, {_even('plddt', 10)} AS bin_3 FROM {_bounded('metric1', 'metric2', 'plddt')}", 3) + " SELECT * FROM result",
    "raw_votes": VOTES + " SELECT header, array_to_string(list_sort(list(bin)), ',') AS bins FROM votes GROUP BY header",
    "vote_ratios": VOTES + f""", headers AS (SELECT header FROM source ORDER BY pos LIMIT 100),
t AS (SELECT header, count(*) AS total FROM votes WHERE header IN (SELECT header FROM headers) GROUP BY header)
SELECT header, CAST(b AS INTEGER) AS bin, round((SELECT count(*) FROM votes v WHERE v.header = t.header AND v.bin = b) / total, 6) AS ratio FROM t, range(1, {BINS + 1}) r(b)""",
    "bin_distribution": VOTE_FOCUSED + f""" SELECT CAST(b AS INTEGER) AS bin, count(Bin_Assignment) AS sequences FROM range(1, {BINS + 1}) r(b)
LEFT JOIN result ON least(Bin_Assignment, {BINS}) = b AND Bin_Assignment BETWEEN 1 AND {BINS + 1} GROUP BY b""",
    "pair_groups": f"WITH {MEMBER}, {METRIC} SELECT structure_id, n_members, metric1 FROM (SELECT structure_id, count(*) AS n_members FROM member GROUP BY 1) JOIN metric USING (structure_id) WHERE plddt > 50",
    "metric_bounds": f"WITH {METRIC} SELECT min(metric1) AS lo, max(metric1) AS hi FROM metric",
    "coverage_filter": f"""WITH {MSA} SELECT pos, length(seq) AS n_chars FROM msa WHERE 1 - (length(seq) - length(replace(seq, ' ', ''))) / (SELECT CAST(arg_min(length(seq), pos) AS DOUBLE) FROM msa) >= 0.5""",
    "gap_fraction": f"WITH {MSA} SELECT pos, round((length(seq) - length(replace(seq, ' ', ''))) / nullif(CAST(length(seq) AS DOUBLE), 0), 6) AS gaps FROM msa",
    "header_key": f"WITH {MSA} SELECT pos, regexp_extract(substr(line, 2), '^\\s*(\\S*)', 1) AS header FROM msa",
    "strip_insertions": f"WITH {MSA} SELECT pos, regexp_replace(seq, '\\p{{Ll}}', '', 'g') AS seq FROM msa",
    "strict_residues": f"WITH {MSA} SELECT pos, regexp_replace(seq, '[^\\p{{Lu}}-]', '', 'g') AS seq FROM msa",
    "parse_a3m": """WITH lines AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
records AS (SELECT file_id, i AS pos, 'd' || (i - 1) % 7 AS header, regexp_replace(regexp_replace(replace(s, '>', ')'), '\\s', '', 'g'), '\\p{Ll}', '', 'g') AS seq FROM lines)
SELECT file_id, min(pos) AS pos, header, arg_max(seq, pos) AS seq FROM records GROUP BY file_id, header""",
    "last_wins": """WITH r AS (SELECT l_partkey AS header, CAST(l_orderkey * 1000 + l_linenumber * 100 + l_quantity AS BIGINT) AS pos FROM lineitem)
SELECT header, min(pos) AS pos, max(pos) % 97 AS seq FROM r GROUP BY header""",
    "distinct_entries": """WITH r AS (SELECT doc_id AS pos, 'd' || doc_id % 50 AS header, regexp_replace(text, '[^\\p{Lu}-]', '', 'g') AS seq FROM documents)
SELECT min(pos) AS pos, header, seq FROM r WHERE header <> 'd7' AND seq <> '' GROUP BY header, seq""",
    "header_set": "SELECT DISTINCT source AS header FROM documents",
    "map_and_extract": f"WITH {OTHER}, {CHOSEN} SELECT c.pos, header, seq FROM chosen c JOIN source s USING (header)",
    "missing_headers": f"WITH {OTHER}, {CHOSEN} SELECT header FROM chosen WHERE header NOT IN (SELECT header FROM source)",
    "compile_sequences": f"WITH {OTHER}, {CHOSEN} SELECT pos, header, seq FROM source WHERE header IN (SELECT header FROM chosen)",
    "control_sample": f"WITH {SOURCE} SELECT pos, header FROM source ORDER BY {_key(chr(39) + '7' + chr(39), chr(39) + '0' + chr(39))}, header LIMIT 300",
    "random_select": f"WITH {SOURCE} SELECT header FROM source ORDER BY {_key(chr(39) + '3' + chr(39), chr(39) + '0' + chr(39))}, header LIMIT 500",
    "shuffle_groups": f"""WITH {SOURCE}, r AS (SELECT CAST(s AS INTEGER) AS shuffle, header, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || s || '|' || header), header) AS rank FROM source, range(1, 5) t(s))
SELECT shuffle, CAST((rank + 15) // 16 AS INTEGER) AS "group", rank, header FROM r""",
    "merge_tail_groups": f'WITH {_groups(50)} SELECT "group", header FROM groups',
    "leave_one_out": f'WITH {_groups(GROUP)} SELECT CAST(s.g AS INTEGER) AS sampling, header FROM groups JOIN (SELECT DISTINCT "group" AS g FROM groups) s ON "group" <> s.g',
    "make_splits": f"SELECT sampling, \"group\", rank, header FROM ({_splits(GROUP, 'SELECT 1 AS round, 5 AS seed')})",
    "m_fold_rounds": _splits(2 * GROUP, "SELECT CAST(r AS INTEGER) AS round, 9 + r AS seed FROM range(1, 3) t(r)"),
    "plddt": "SELECT l_orderkey AS structure_id, round(avg(CASE WHEN l_linenumber <= 5 THEN l_quantity END), 6) AS plddt, round(avg(CASE WHEN l_linenumber IN (2, 3) THEN l_quantity END), 6) AS local_plddt FROM lineitem GROUP BY 1",
    "seq_count": "SELECT l_orderkey AS structure_id, count(*) + 1 AS seq_count FROM lineitem GROUP BY 1",
    "filter_plddt": f"WITH {METRIC} SELECT structure_id, plddt FROM metric WHERE plddt > 50",
    "quantile_filter": f"""WITH {METRIC} SELECT structure_id, metric1, metric2 FROM metric
WHERE metric1 > (SELECT quantile_cont(metric1, 0.6) FROM metric) AND metric2 < (SELECT quantile_cont(metric2, 0.4) FROM metric)""",
    "combine_by_threshold": f"WITH {METRIC} SELECT structure_id FROM metric WHERE metric1 > 200000",
    "enrich_step": f"""WITH {MEMBER}, {METRIC}, {_ENTRIES}, sure AS (SELECT * FROM metric WHERE plddt > 50),
kept AS (SELECT * FROM entries WHERE structure_id IN (SELECT structure_id FROM sure WHERE metric1 > (SELECT quantile_cont(metric1, 0.8) FROM sure))) {_DISTINCT.format('kept')}""",
    "gather": f"WITH {MEMBER}, {METRIC}, {_ENTRIES}, kept AS (SELECT * FROM entries WHERE structure_id IN (SELECT structure_id FROM metric WHERE metric1 > 250000)) {_DISTINCT.format('kept')}",
    "hist_by_iteration": f"""WITH {METRIC}, edges AS (SELECT CAST(k AS INTEGER) AS bin, (k - 1) * 2.5 AS bin_lo, k * 2.5 AS bin_hi FROM range(1, 41) r(k))
SELECT i.iteration, bin, CAST(bin_lo AS DOUBLE) AS bin_lo, CAST(bin_hi AS DOUBLE) AS bin_hi,
       (SELECT count(*) FROM metric m WHERE m.iteration = i.iteration AND plddt >= bin_lo AND (plddt < bin_hi OR bin = 40 AND plddt = bin_hi)) AS n
FROM (SELECT DISTINCT iteration FROM metric) i, edges""",
    "hist_1d": f"""WITH {METRIC}, e AS (SELECT {_edges('lo', 'hi', 50)} AS e FROM (SELECT min(metric1) AS lo, max(metric1) AS hi FROM metric)),
b AS (SELECT CAST(k AS INTEGER) AS bin, e[k] AS bin_lo, e[k + 1] AS bin_hi FROM e, range(1, 51) r(k))
SELECT bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, (SELECT count(*) FROM metric WHERE metric1 >= bin_lo AND (metric1 < bin_hi OR bin = 50 AND metric1 = bin_hi)) AS n FROM b""",
    "quantile_marker": f"WITH {METRIC} SELECT iteration, round(quantile_cont(metric1, 0.8), 6) AS marker FROM metric GROUP BY 1",
    "summary": f"WITH {METRIC} SELECT round(avg(plddt), 6) AS mean, round(median(plddt), 6) AS median FROM metric",
    "kde_marginals": f"""WITH {METRIC}, s AS (SELECT count(*) AS n, stddev_samp(plddt) * pow(count(*), -0.2) AS h, min(plddt) AS lo, max(plddt) AS hi FROM metric),
g AS (SELECT CAST(k AS INTEGER) AS point, n, h, lo - 3 * h + k * ((hi + 3 * h - (lo - 3 * h)) / 199) AS x FROM s, range(200) r(k))
SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - plddt) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM g, metric GROUP BY point, x""",
    "scatter_table": f"WITH {METRIC} SELECT metric1 AS m1, metric2 AS m2, plddt AS confidence FROM metric",
    "center_of_mass": f"WITH {BACKBONE}, c AS (SELECT structure_id, {_center('c', 'res_seq <= 3')} FROM bb GROUP BY 1) SELECT structure_id, round(c_x, 6) AS x, round(c_y, 6) AS y, round(c_z, 6) AS z FROM c",
    "residue_distance": f"WITH {BACKBONE}, c AS (SELECT structure_id, {_center('a', 'res_seq <= 2')}, {_center('b', 'res_seq >= 5')} FROM bb GROUP BY 1) SELECT structure_id, round({_norm('a', 'b')}, 6) AS distance FROM c",
    "domain_angle": f"WITH {BACKBONE}, c AS (SELECT structure_id, {_center('a', 'res_seq <= 2')}, {_center('b', 'res_seq >= 6')}, {_center('h', 'res_seq = 4')} FROM bb GROUP BY 1) SELECT structure_id, round({_ANGLE}, 6) AS angle FROM c",
    "rmsd": f"WITH {CA}, {_pairs('p', 'ca', 'res_seq')} SELECT structure_id, round(sqrt(avg((tx - rx) * (tx - rx) + (ty - ry) * (ty - ry) + (tz - rz) * (tz - rz))), 6) AS rmsd FROM p GROUP BY 1",
    "ca_rmsd": f"WITH {CA}, {_pairs('p', 'ca', 'res_seq', 'res_seq > 2')}, {_pose('p')} SELECT structure_id, round(sqrt(greatest(0, 2 * (e0 - root) / n)), 6) AS rmsd, n AS n_pairs FROM rooted",
    "ca_rmsd_two_sets": f"WITH {CA}, {_pairs('p', 'ca', 'res_seq')}, s AS (SELECT * FROM p WHERE res_seq <= 11), {_pose('s')}, {_moved('p')} SELECT structure_id, round(sqrt(avg(d2)), 6) AS rmsd, count(*) AS n_pairs FROM moved GROUP BY 1",
    "all_atom_rmsd": f"""WITH {BACKBONE}, {_pairs('p', 'bb', 'res_seq, atom_name', 't.res_seq BETWEEN 2 AND 6')}, {_pairs('s', 'bb', 'res_seq, atom_name', "t.atom_name = 'CA'")}, {_pose('s')}, {_moved('p')}
SELECT structure_id, round(sqrt(avg(d2)), 6) AS all_atom_rmsd, count(*) AS n_pairs FROM moved GROUP BY 1""",
    "tm_score_paired": f"WITH {CA}, {_pairs('p', 'ca', 'res_seq')}, {_pose('p')}, {_moved('p')} SELECT structure_id, round(sum(1 / (1 + d2 / pow(greatest(0.5, 1.24 * cbrt(6) - 1.8), 2))) / 21, 6) AS tm_paired FROM moved GROUP BY 1",
    "all_metrics": f"""WITH {BACKBONE}, c AS (SELECT structure_id, avg(b_factor) AS b, {_center('a', 'res_seq <= 2')}, {_center('b', 'res_seq >= 6')}, {_center('h', 'res_seq = 4')}, {_center('d', 'res_seq >= 5')} FROM bb GROUP BY 1)
SELECT structure_id AS PDB, round(b, 6) AS plddt, round(b, 6) AS local_plddt, round({_norm('a', 'd')}, 6) AS gap, round({_ANGLE}, 6) AS bend FROM c WHERE b > 30""",
    "pdb_atoms": f"""WITH {BACKBONE} SELECT structure_id, CAST(line_no AS BIGINT) AS line_no, 1 AS model, atom_name, res_name, 'A' AS chain, res_seq, CAST(printf('%8.3f', x * 10) AS DOUBLE) AS x, CAST(printf('%8.3f', y * 10) AS DOUBLE) AS y,
CAST(printf('%8.3f', z * 10) AS DOUBLE) AS z, b_factor, element FROM bb""",
    "protein_sequence": f"""WITH {BACKBONE}, n AS (SELECT * FROM bb WHERE atom_name = 'N'), c AS (SELECT * FROM bb WHERE atom_name = 'C'),
bonds AS (SELECT c.structure_id, c.res_seq FROM c JOIN n ON c.structure_id = n.structure_id AND n.res_seq = c.res_seq + 1
  WHERE sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) + (c.z - n.z) * (c.z - n.z)) < 1.8),
linked AS (SELECT structure_id, res_seq FROM bonds UNION SELECT structure_id, res_seq + 1 FROM bonds)
SELECT structure_id, repeat(['G', 'A', 'S'][structure_id % 3 + 1], CAST(count(*) AS INTEGER)) AS seq FROM linked GROUP BY structure_id""",
    "path_keys": f"""WITH {_PATHS} SELECT structure_id, split_part(path, '_unrelaxed', 1) || '.a3m' AS group_file, CAST(CASE WHEN structure_id % 5 = 0 THEN 0 ELSE structure_id % 8 END AS INTEGER) AS seed,
CAST(structure_id % 3 AS INTEGER) AS round, CAST(structure_id % 7 AS INTEGER) AS sampling, CAST(structure_id % 11 AS INTEGER) AS "group" FROM paths WHERE structure_id % 10 <> 0""",
    "missing_predictions": "SELECT o_orderkey AS structure_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "prediction_manifest": VOTE_FOCUSED + """ SELECT arm, 'bin_' || b AS bin_label, p || 'bin' || b AS job FROM (SELECT DISTINCT Bin_Assignment AS b FROM result WHERE Bin_Assignment IN (1, 5, 9, 40)),
(VALUES ('prediction', 'pred_'), ('control', 'ctrl_pred_')) t(arm, p)""",
    "recompile_bins": VOTE_FOCUSED + """, chosen AS (SELECT 'bin_' || Bin_Assignment AS bin_label, s.pos, s.header FROM result JOIN source s ON Sequence_Header = s.header WHERE Bin_Assignment IN (1, 5, 9)),
drawn AS (SELECT pos, header, row_number() OVER (ORDER BY md5('11|0|' || header), header) AS rank FROM source)
SELECT 'prediction' AS arm, bin_label, pos, header FROM chosen UNION ALL
SELECT 'control', bin_label, pos, header FROM drawn JOIN (SELECT bin_label, count(*) AS n FROM chosen GROUP BY 1) ON rank <= n""",
    "arm_metrics": _ARMS + " SELECT arm, bin_label, path AS PDB, CAST(coalesce(nullif(regexp_extract(path, 'seed_([0-9]+)', 1), ''), '0') AS INTEGER) AS seed, metric1 AS m1, metric2 AS m2, plddt FROM arms WHERE plddt > 50",
    "pair_arms": _ARMS + " SELECT bin_label, count(*) FILTER (WHERE arm = 'prediction') AS n_prediction, count(*) FILTER (WHERE arm = 'control') AS n_control FROM arms GROUP BY 1",
    "union_rounds": f"WITH {METRIC} SELECT round, count(*) AS structures, max(metric1) AS top FROM metric GROUP BY 1",
    "merge_metric_files": """SELECT l_orderkey AS PDB, max(CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS DOUBLE) END) AS m1, max(CASE WHEN l_linestatus = 'O' THEN l_linenumber * CAST(2 AS DOUBLE) END) AS m2 FROM lineitem GROUP BY 1""",
    "job_log_status": "SELECT 'job_' || user_id AS dir, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1",
    "combine_by_rmsd": f"WITH {METRIC} SELECT structure_id FROM metric WHERE metric2 < 100000",
    "select_metrics": f"WITH {METRIC} SELECT structure_id, metric2 FROM metric",
    "order_by_confidence": f"WITH {METRIC} SELECT structure_id, plddt FROM metric ORDER BY plddt",
    "prepare_iteration": f"""WITH {MSA}, kept AS (SELECT 'd' || pos AS header FROM msa WHERE 1 - (length(seq) - length(replace(replace(seq, ' ', '-'), '-', ''))) / (SELECT CAST(arg_min(length(seq), pos) AS DOUBLE) FROM msa) >= 0.5),
r AS (SELECT CAST(s AS INTEGER) AS shuffle, header, row_number() OVER (PARTITION BY s ORDER BY md5('3|' || s || '|' || header), header) AS rank FROM kept, range(1, 3) t(s))
SELECT shuffle, CAST((rank + 15) // 16 AS INTEGER) AS "group", rank, header FROM r""",
    "concat_groups": f"""WITH {MEMBER}, {_ENTRIES}, e AS (SELECT header, CAST(structure_id % 3 AS INTEGER) AS file_rank, pos FROM entries WHERE structure_id % 3 < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY file_rank, pos) AS k FROM e)
SELECT file_rank, pos, header, 'S' AS seq FROM r WHERE k = 1""",
    "superposed_metrics": f"""WITH {CA}, {_pairs('p', 'ca', 'res_seq')}, s AS (SELECT * FROM p WHERE res_seq <= 11), {_pose('s')}, {_moved('p')},
fit AS (SELECT structure_id, round(sqrt(avg(d2)), 6) AS fit FROM moved GROUP BY 1),
tm AS (WITH {_pose('p')}, {_moved('p')} SELECT structure_id, round(sum(1 / (1 + d2 / pow(greatest(0.5, 1.24 * cbrt(6) - 1.8), 2))) / 21, 6) AS tm FROM moved GROUP BY 1)
SELECT structure_id AS PDB, CAST(structure_id % 100 AS DOUBLE) AS plddt, fit, tm FROM fit JOIN tm USING (structure_id) WHERE structure_id % 100 > 30""",
    "combined_manifest": VOTE_FOCUSED + """ SELECT arm, 'bin_1_5_9' AS bin_label, p || 'bin_1_5_9' AS job FROM (VALUES ('prediction', 'pred_'), ('control', 'ctrl_pred_')) t(arm, p)
WHERE (SELECT count(*) FROM result WHERE Bin_Assignment IN (1, 5, 9)) > 0""",
    "recompile_combined": VOTE_FOCUSED + """, chosen AS (SELECT s.pos, s.header FROM result JOIN source s ON Sequence_Header = s.header WHERE Bin_Assignment IN (1, 5, 9)),
drawn AS (SELECT pos, header, row_number() OVER (ORDER BY md5('11|0|' || header), header) AS rank FROM source)
SELECT 'prediction' AS arm, 'bin_1_5_9' AS bin_label, pos, header FROM chosen UNION ALL
SELECT 'control', 'bin_1_5_9', pos, header FROM drawn WHERE rank <= (SELECT count(*) FROM chosen)""",
    "union_iterations": f"WITH {METRIC} SELECT iteration, count(*) AS structures, max(metric1) AS top FROM metric WHERE iteration <= 1996 GROUP BY 1",
    "group_files": f"WITH {MEMBER}, {_ENTRIES} SELECT DISTINCT CAST(structure_id % 40 AS INTEGER) AS grp, header, seq FROM entries UNION ALL SELECT DISTINCT CAST(structure_id % 40 AS INTEGER), '101', 'QQ' FROM entries",
    "raw_votes_file": VOTES + " SELECT CAST(header AS VARCHAR) AS header, bin, count(*) AS n FROM votes GROUP BY ALL",
    "voting_results_file": VOTE_FOCUSED + " SELECT * REPLACE (CAST(Sequence_Header AS VARCHAR) AS Sequence_Header) FROM result",
    "aligner_scores": f"WITH {METRIC} SELECT CAST(structure_id AS VARCHAR) AS PDB, plddt, metric1 FROM metric WHERE plddt > 50 AND metric1 > 200000",
    "criterion_atoms": f"""WITH {CA}, residues AS (SELECT 'fit' AS name, 'sup' AS role, unnest(range(1, 12)) AS res_seq UNION ALL SELECT 'fit', 'rms', unnest(range(1, 22)) UNION ALL SELECT 'gap', 'set1', unnest([1, 2]) UNION ALL SELECT 'gap', 'set2', unnest(range(18, 22)))
SELECT name, role, count(*) AS atoms, round(avg(CAST(structure_id % 100 AS DOUBLE)), 6) AS confidence FROM ca JOIN residues USING (res_seq) GROUP BY name, role""",
    "vote_arrivals": VOTE_FOCUSED + " SELECT * FROM result",
    "late_predictions": f"WITH {MEMBER} SELECT structure_id, avg(header) AS m1, count(*) AS seq_count FROM member GROUP BY 1",
    "bucketed_votes": VOTE_FOCUSED + " SELECT * FROM result",
}
ORACLE_SQL["resumed_step"] = ORACLE_SQL["enrich_step"]

"""Queries on hits, names, lengths, alignments and distances, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.functions import sequences as seq
from cladeframe.functions.lineage import materialise
from cladeframe.operators import distance, merge, profile, routing, sites

from . import outputs
from .fixtures import KEYS, SQL_DENSE, SQL_GAPPY, SQL_VALUES, dense, gappy, hits, table, values

HITS = "hits AS (SELECT user_id AS fragment, event_type AS subset, max(value) AS bitscore, min(value) AS evalue FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY bitscore DESC, subset) AS r FROM hits WHERE bitscore IS NOT NULL) WHERE r = 1)"


def best_hit_routing(spark, d):
    return routing.best_hit(hits(spark, d), ["subset"]).select("fragment", "subset", "bitscore")


def unscored_fragments(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("fragment"))
    return routing.unscored(people, hits(spark, d))


def fragment_chunks(spark, d):
    best = routing.best_hit(hits(spark, d), ["subset"])
    return routing.round_robin(best, routing.chunks_per_subset(5, 8), ["fragment"], ["subset"]).select("fragment", "subset", "chunk")


def all_scores(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("fragment"))
    got = routing.all_scores(people, hits(spark, d))
    text = F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s["bitscore"])), " ")
    return got.select("fragment", F.size("scores").cast("long").alias("n"), text.alias("scores"))


def score_lines(spark, d):
    lines = routing.score_lines(hits(spark, d).where("bitscore is not null and evalue is not null"))
    return lines.select("seq", "bitscore", F.length("evalue").cast("long").alias("evalue_width"))


def name_collisions(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("name"))
    return routing.collisions(q, table(spark, d, "benchmark").select(F.col("item_id").alias("name")))


def collision_free_queries(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("name"), "source")
    return routing.without_collisions(q, table(spark, d, "benchmark").select(F.col("item_id").alias("name")), ignore=True)


def whitespace_names(spark, d):
    return routing.whitespace_names(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")))


def fragment_names(spark, d):
    """Names made of documents with four parts to drop, and the prior in the last of them."""
    t = table(spark, d, "documents")
    name = F.concat_ws("_", F.lit("frag"), "doc_id", F.coalesce("lang", F.lit("x")), F.coalesce("source", F.lit("x")), F.col("n_chars") % 7, F.col("n_chars") * 13 % 1_000_001)
    return t.select("doc_id", seq.renamed(name).alias("name"), seq.prior(name).alias("prior"))


def subset_sizes(spark, d):
    """Subset sizes for as many leaves as a part's key says, given its size and price or not."""
    t = table(spark, d, "part").withColumn("n", F.col("p_partkey") % 997 + 1)
    a, p = routing.size_columns(F.col("n"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")), F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") % 60))
    return t.select("p_partkey", "n", a.alias("alignment"), p.alias("placement"))


def fragment_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("seq"))
    return routing.split_by_length(rows, 1500).select("doc_id", "is_fragment", F.length("seq").cast("long").alias("n"))


def length_quantile_band(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("seq"))
    m = routing.length_quantile(rows)
    return routing.length_band(rows, m).select("doc_id", "full")


def length_quantiles(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("text").alias("seq"))
    return routing.length_quantile(rows, 0.25, keys=["source"])


def hash_sample(spark, d):
    return routing.sample_names(table(spark, d, "documents").select(F.col("doc_id").alias("name")), 100)


def last_value_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("name"), "event_id", "event_type", "value")
    return routing.last_wins(e, "event_id")


def degapped_rows(spark, d):
    rows = sites.to_rows(dense(spark, d), KEYS)
    return rows.select("name", seq.degap("seq").alias("seq"))


def gap_columns(spark, d):
    return sites.columns(gappy(spark, d), KEYS)


def compact_subsets(spark, d):
    return sites.delete_all_gap(_grouped(spark, d), GRP)


def compacted_rows(spark, d):
    return sites.to_rows(sites.delete_all_gap(_grouped(spark, d), GRP), GRP)


def kept_columns(spark, d):
    s = dense(spark, d)
    c = sites.columns(s, KEYS).where("residues % 3 = 0")
    return sites.keep_columns(s, c, KEYS).groupBy(*KEYS, "pos").agg(F.count("*").alias("n"), F.min("ch").alias("low"))


def removed_columns(spark, d):
    s = dense(spark, d)
    c = sites.columns(s, KEYS).where("residues % 3 = 0")
    return sites.remove_columns(s, c, KEYS).groupBy(*KEYS, "pos").agg(F.count("*").alias("n"), F.min("ch").alias("low"))


def added_column(spark, d):
    rows = sites.to_rows(dense(spark, d)).select("name", "seq")
    lookup = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("name"), F.lit("N").alias("ch"))
    return sites.remove_column(sites.add_column(rows, 10, lookup=lookup), 0)


def alignment_shapes(spark, d):
    return sites.inspect(sites.to_rows(dense(spark, d), KEYS), KEYS)


GRP = ["grp", "block"]


def _labels(cols):
    """Columns with few residues are insertions."""
    n = F.row_number().over(Window.partitionBy(*GRP, F.col("residues") >= 2).orderBy("pos")) - 1
    return cols.withColumn("label", F.when(F.col("residues") >= 2, n).otherwise(-1))


def _grouped(spark, d):
    return gappy(spark, d).withColumnRenamed("label", "grp")


def mask_insertions(spark, d):
    s = _grouped(spark, d)
    return sites.to_rows(sites.mask_insertions(s, _labels(sites.columns(s, GRP)), GRP), GRP)


def insertion_ranges(spark, d):
    c = _labels(sites.columns(_grouped(spark, d), GRP)).where("label < 0")
    return sites.ranges_text(sites.islands(c.select(*GRP, "pos"), GRP), GRP)


def relabelled_columns(spark, d):
    c = _labels(sites.columns(_grouped(spark, d), GRP)).select(*GRP, "pos", "label")
    to = c.where("label >= 0").select(*GRP, F.col("label").alias("nth"), (F.col("label") * 2 + 5).alias("label"))
    return sites.relabel(c, to, GRP)


def _extended(spark, d):
    """Alignments of all (label, block) are the inputs of one merge: their columns with at most one residue are
    insertions, but for every third; original columns are labelled by their position."""
    s = _grouped(spark, d)
    c = sites.columns(s, GRP)
    c = c.withColumn("label", F.when((F.col("residues") >= 2) | (F.col("pos") % 3 == 0), F.col("pos")).otherwise(-1))
    co = merge.coordinates(c.select(*GRP, "pos", "label"), GRP)
    return s.join(co, [*GRP, "pos"]).withColumn("input", F.concat_ws(":", "grp", "block")), co


def extended_merge(spark, d):
    s, co = _extended(spark, d)
    m = merge.merge(s.drop("label", "pos"), "input")
    return m.select("name", "pos", "ch")


def alignment_outputs(spark, d):
    """The files of the merged alignment: all columns, columns that are no insertions, and the insertions' ranges."""
    s, co = _extended(spark, d)
    cols = materialise(merge.merged_columns(co.select("anchor", "ord").distinct()))
    return outputs.alignment_files(materialise(merge.merge(s.drop("label", "pos"), "input").select("name", "pos", "ch")), cols)


def merged_columns(spark, d):
    _, co = _extended(spark, d)
    return merge.merged_columns(co.select("anchor", "ord").distinct())


def pairwise_p_distance(spark, d):
    return distance.pairs(dense(spark, d), KEYS).withColumn("d", F.round("d", 6))


def subset_p_distance(spark, d):
    got = distance.summary(distance.pairs(dense(spark, d), KEYS), KEYS)
    return got.select(*KEYS, "pairs", F.round("mean", 6).alias("mean"), F.round("largest", 6).alias("largest"))


def p_distance_gap_as_state(spark, d):
    got = distance.summary(distance.pairs(dense(spark, d), KEYS, gap_is_state=True), KEYS)
    return got.select(*KEYS, "pairs", F.round("mean", 6).alias("mean"), F.round("largest", 6).alias("largest"))


def hamming_of_neighbours(spark, d):
    rows = sites.to_rows(dense(spark, d), KEYS)
    w = Window.partitionBy(*KEYS).orderBy("name")
    near = rows.withColumn("before", F.lag("seq").over(w)).where("before is not null")
    return near.select("name", F.round(seq.hamming("before", "seq"), 6).alias("d"))


def _dna(spark, d, whole=False):
    v = values(spark, d) if whole else values(spark, d).where("pos < 63")
    base = F.when(F.col("x") >= 0.08, "T").when(F.col("x") >= 0, "C").when(F.col("x") >= -0.08, "A").otherwise("G")
    return sites.to_rows(v.withColumn("ch", base), KEYS)


def translated(spark, d):
    codons = _dna(spark, d).select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.substr("seq", k * 3 + 1, F.lit(3)))).alias("k", "codon"))
    return codons.select("name", F.col("k").alias("pos"), "codon", seq.amino_of("codon").alias("amino"), seq.is_compatible("codon", seq.amino_of("codon")).alias("fits"))


def codon_checks(spark, d):
    dna = _dna(spark, d, whole=True).withColumn("codons", F.expr("transform(sequence(1, greatest(length(seq) div 3, 1)), k -> substr(seq, k * 3 - 2, 3))"))
    each = dna.select("name", "codons", F.posexplode("codons").alias("k", "codon")).where("length(codon) = 3")
    after = F.coalesce(seq.amino_of(F.get("codons", F.col("k") + 1)), F.lit("X"))
    third = F.concat(F.substr("codon", F.lit(1), F.lit(2)), F.lit("N"))
    each = each.select("name", F.col("k").alias("pos"), "codon", after.alias("next_amino"), third.alias("open_codon"))
    return each.withColumn("fits", seq.is_compatible("codon", "next_amino")).withColumn("ambiguous", seq.is_ambiguous("open_codon"))


def backtranslate(spark, d):
    dna = _dna(spark, d)
    aa = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.concat(F.when((k + F.col("name")) % 4 == 0, "-").otherwise(""), seq.amino_of(F.substr("seq", k * 3 + 1, F.lit(3)))))
    return seq.backtranslate(dna.select("name", F.array_join(aa, "").alias("seq")), dna.select("name", "seq"))


def model_scores(spark, d):
    """X1, X2: every alignment row against the profiles of all blocks of its label."""
    s = dense(spark, d)
    p = profile.build(s, KEYS)
    got = profile.score(s.withColumnRenamed("block", "own"), p, ["label"], ["block"])
    return got.select("label", "block", "name", F.round("score", 6).alias("score"))


def routed_rows(spark, d):
    """X2, WN3: the block whose profile scores a row best."""
    s = dense(spark, d)
    # Scores that may be alike once rounded all come back.
    got = profile.score(s.withColumnRenamed("block", "own"), profile.build(s, KEYS), ["label"], ["block"], within=2e-6)
    best = routing.best_hit(got.withColumn("bitscore", F.round("score", 6)), ["block"], fragment="name")
    return best.select("name", "label", "block", "bitscore")


NAMES = """best_hit_routing unscored_fragments fragment_chunks all_scores score_lines name_collisions collision_free_queries whitespace_names fragment_split
length_quantile_band length_quantiles hash_sample last_value_wins degapped_rows gap_columns compact_subsets compacted_rows kept_columns removed_columns added_column
fragment_names subset_sizes alignment_shapes mask_insertions insertion_ranges relabelled_columns extended_merge alignment_outputs merged_columns pairwise_p_distance subset_p_distance p_distance_gap_as_state
hamming_of_neighbours translated codon_checks backtranslate model_scores routed_rows""".split()
QUERIES = {n: globals()[n] for n in NAMES}

COLS = "cols AS (SELECT label, block, pos, count(*) FILTER (ch <> '-') AS residues FROM sites GROUP BY ALL)"
ROWS = "rows_ AS (SELECT label, block, name, string_agg(ch, '' ORDER BY pos) AS seq FROM sites GROUP BY ALL)"
LABELS = """labelled AS (SELECT label, block, pos, residues, CASE WHEN residues >= 2 THEN row_number() OVER (PARTITION BY label, block, residues >= 2 ORDER BY pos) - 1 ELSE -1 END AS l FROM cols)"""
QUANT = """srt AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY g) AS c FROM lens),
q AS (SELECT g, CASE WHEN any_value(c) % 2 = 1 OR any_value(floor(c * {q})) = any_value(c) - 1 THEN max(CASE WHEN r = floor(c * {q}) THEN n END)::DOUBLE
  ELSE (max(CASE WHEN r = floor(c * {q}) THEN n END) + max(CASE WHEN r = floor(c * {q}) + 1 THEN n END)) / 2.0 END AS length FROM srt GROUP BY g)"""
PAIRS = """nm AS (SELECT DISTINCT label, block, name FROM sites),
ap AS (SELECT a.label, a.block, a.name AS a, b.name AS b FROM nm a JOIN nm b ON a.label = b.label AND a.block = b.block AND a.name < b.name),
met AS (SELECT x.label, x.block, x.name AS a, y.name AS b, count(*) AS shared, sum(CASE WHEN x.ch <> y.ch THEN 1 ELSE 0 END) AS unlike
  FROM sites x JOIN sites y ON x.label = y.label AND x.block = y.block AND x.pos = y.pos AND x.name < y.name {where} GROUP BY ALL),
pr AS (SELECT ap.*, coalesce(shared, 0) AS shared, coalesce(unlike / shared, 0.0) AS d FROM ap LEFT JOIN met USING (label, block, a, b))"""
NOGAP = "WHERE x.ch <> '-' AND y.ch <> '-'"
EXT = f"""{SQL_GAPPY}, {COLS},
lab AS (SELECT label, block, pos, CASE WHEN residues >= 2 OR pos % 3 = 0 THEN pos ELSE -1 END AS l FROM cols),
anch AS (SELECT *, coalesce(max(CASE WHEN l >= 0 THEN l END) OVER (PARTITION BY label, block ORDER BY pos), -1) AS anchor FROM lab),
co AS (SELECT *, (sum(CASE WHEN l < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label, block, anchor ORDER BY pos))::INT AS ord FROM anch),
mc AS (SELECT anchor, ord, (row_number() OVER (ORDER BY anchor, ord) - 1)::INT AS pos FROM (SELECT DISTINCT anchor, ord FROM co))"""
DNA = f"""{SQL_VALUES}, nt AS (SELECT name, string_agg(CASE WHEN x >= 0.08 THEN 'T' WHEN x >= 0 THEN 'C' WHEN x >= -0.08 THEN 'A' ELSE 'G' END, '' ORDER BY pos) AS seq FROM vals WHERE pos < 63 GROUP BY name),
cod AS (SELECT name, k, substr(seq, k * 3 + 1, 3) AS codon FROM nt, (SELECT unnest(range(0, 21)) AS k)),
tr AS (SELECT *, substr('{seq.AMINO}', ((instr('TCAG', substr(codon, 1, 1)) - 1) * 16 + (instr('TCAG', substr(codon, 2, 1)) - 1) * 4 + instr('TCAG', substr(codon, 3, 1)))::INT, 1) AS amino FROM cod)"""
SCORES = f"""{SQL_DENSE}, freq AS (SELECT label, block, pos, ch, count(*) AS n FROM sites WHERE ch <> '-' GROUP BY ALL),
depth AS (SELECT label, block, pos, sum(n) AS tot FROM freq GROUP BY ALL),
model AS (SELECT d.label, d.block, d.pos, c.ch, ln((coalesce(n, 0) + 0.25) / (tot + 1.0) / 0.25) / ln(2.0) AS w FROM depth d CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS ch) c LEFT JOIN freq f ON f.label = d.label AND f.block = d.block AND f.pos = d.pos AND f.ch = c.ch),
sc AS (SELECT s.label, m.block, s.name, round(sum(w), 6) AS score FROM sites s JOIN model m ON s.label = m.label AND s.pos = m.pos AND s.ch = m.ch GROUP BY ALL)"""

ORACLES = {
    "best_hit_routing": f"WITH {HITS}, {BEST} SELECT fragment, subset, bitscore FROM best",
    "unscored_fragments": f"WITH {HITS} SELECT DISTINCT c_custkey AS fragment FROM customer WHERE c_custkey NOT IN (SELECT fragment FROM hits WHERE bitscore IS NOT NULL)",
    "fragment_chunks": f"WITH {HITS}, {BEST} SELECT fragment, subset, ((row_number() OVER (PARTITION BY subset ORDER BY fragment) - 1) % 8)::INT AS chunk FROM best",
    "all_scores": f"WITH {HITS} SELECT c_custkey AS fragment, count(bitscore) AS n, coalesce(string_agg(printf('%.4f', bitscore), ' ' ORDER BY bitscore DESC, evalue DESC) FILTER (bitscore IS NOT NULL), '') AS scores FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN hits ON fragment = c_custkey GROUP BY ALL",
    "score_lines": f"WITH {HITS} SELECT fragment AS seq, printf('%.4f', bitscore) AS bitscore, length(printf('%.3e', evalue)) AS evalue_width FROM hits WHERE bitscore IS NOT NULL AND evalue IS NOT NULL",
    "name_collisions": "SELECT DISTINCT doc_id AS name FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "collision_free_queries": "SELECT doc_id AS name, source FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)",
    "whitespace_names": "SELECT p_partkey, p_name AS name FROM part WHERE regexp_matches(p_name, '[ \\t]')",
    "fragment_split": "SELECT doc_id, length(text) <= 1500 AS is_fragment, length(text) AS n FROM documents",
    "length_quantile_band": f"WITH lens AS (SELECT 0 AS g, length(replace(text, '-', '')) AS n FROM documents), {QUANT.format(q=0.5)} SELECT doc_id, length(replace(text, '-', '')) BETWEEN floor((SELECT length FROM q) * 0.75) AND floor((SELECT length FROM q) * 1.25) AS \"full\" FROM documents",
    "length_quantiles": f"WITH lens AS (SELECT source AS g, length(replace(text, '-', '')) AS n FROM documents), {QUANT.format(q=0.25)} SELECT g AS source, length FROM q",
    "hash_sample": "SELECT doc_id AS name FROM documents ORDER BY md5('297834|' || doc_id), doc_id LIMIT 100",
    "last_value_wins": "SELECT user_id AS name, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "degapped_rows": f"WITH {SQL_DENSE}, {ROWS} SELECT name, replace(seq, '-', '') AS seq FROM rows_",
    "gap_columns": f"WITH {SQL_GAPPY}, {COLS} SELECT label, block, pos, residues = 0 AS all_gap, residues FROM cols",
    "compact_subsets": f"WITH {SQL_GAPPY}, {COLS}, kept AS (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY pos) - 1 AS p FROM cols WHERE residues > 0) SELECT label AS grp, block, name, k.p AS pos, ch, pos AS label FROM sites JOIN kept k USING (label, block, pos)",
    "compacted_rows": f"WITH {SQL_GAPPY}, {COLS} SELECT label AS grp, block, name, string_agg(ch, '' ORDER BY pos) AS seq FROM sites JOIN cols USING (label, block, pos) WHERE residues > 0 GROUP BY ALL",
    "kept_columns": f"WITH {SQL_DENSE}, {COLS}, kept AS (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY pos) - 1 AS p FROM cols WHERE residues % 3 = 0) SELECT label, block, p AS pos, count(*) AS n, min(ch) AS low FROM sites JOIN kept USING (label, block, pos) GROUP BY ALL",
    "removed_columns": f"WITH {SQL_DENSE}, {COLS}, kept AS (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY pos) - 1 AS p FROM cols WHERE residues % 3 <> 0) SELECT label, block, p AS pos, count(*) AS n, min(ch) AS low FROM sites JOIN kept USING (label, block, pos) GROUP BY ALL",
    "added_column": f"WITH {SQL_DENSE}, {ROWS} SELECT name, substr(seq, 2, 9) || CASE WHEN name % 2 = 0 THEN 'N' ELSE '-' END || substr(seq, 11) AS seq FROM rows_",
    "alignment_shapes": f"WITH {SQL_DENSE}, {ROWS} SELECT label, block, count(*) AS taxa, min(length(seq)) AS shortest, max(length(seq)) AS longest, min(length(seq)) = max(length(seq)) AS aligned FROM rows_ GROUP BY ALL",
    "mask_insertions": f"WITH {SQL_GAPPY}, {COLS} SELECT label AS grp, block, name, string_agg(ch, '' ORDER BY pos) AS seq FROM sites JOIN cols USING (label, block, pos) WHERE residues >= 2 GROUP BY ALL",
    "insertion_ranges": f"WITH {SQL_GAPPY}, {COLS}, isl AS (SELECT label, block, pos, pos - row_number() OVER (PARTITION BY label, block ORDER BY pos) AS g FROM cols WHERE residues < 2), rg AS (SELECT label, block, g, min(pos) AS a, max(pos) AS b FROM isl GROUP BY ALL) SELECT label AS grp, block, string_agg(a || '-' || b, ',' ORDER BY a) AS ranges FROM rg GROUP BY ALL",
    "relabelled_columns": f"WITH {SQL_GAPPY}, {COLS}, {LABELS} SELECT label AS grp, block, pos, (CASE WHEN l < 0 THEN -1 ELSE l * 2 + 5 END)::INT AS label FROM labelled",
    "extended_merge": f"WITH {EXT} SELECT s.name, mc.pos, s.ch FROM sites s JOIN co USING (label, block, pos) JOIN mc ON mc.anchor = co.anchor AND mc.ord = co.ord WHERE s.ch <> '-'",
    "alignment_outputs": f"WITH {EXT}, rs AS (SELECT s.name, mc.pos, s.ch FROM sites s JOIN co USING (label, block, pos) JOIN mc ON mc.anchor = co.anchor AND mc.ord = co.ord WHERE s.ch <> '-'), nms AS (SELECT DISTINCT name FROM rs), full_ AS (SELECT n.name, c.pos, c.ord, coalesce(rs.ch, '-') AS ch FROM nms n CROSS JOIN mc c LEFT JOIN rs ON rs.name = n.name AND rs.pos = c.pos), isl AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM mc WHERE ord > 0), rg AS (SELECT min(pos) AS a, max(pos) AS b FROM isl GROUP BY g) SELECT 'alignment.fasta' AS file, name::VARCHAR AS name, string_agg(ch, '' ORDER BY pos) AS value FROM full_ GROUP BY name UNION ALL SELECT 'alignment_masked.fasta', name::VARCHAR, string_agg(ch, '' ORDER BY pos) FROM full_ WHERE ord = 0 GROUP BY name UNION ALL SELECT 'insertion_columns.txt', NULL, coalesce(string_agg(a || '-' || b, ',' ORDER BY a), '') FROM rg",
    "merged_columns": f"WITH {EXT} SELECT anchor, ord, pos FROM mc",
    "fragment_names": "SELECT doc_id, 'frag_' || doc_id AS name, (n_chars * 13 % 1000001) / 1000000.0 AS prior FROM documents",
    "subset_sizes": "WITH t AS (SELECT p_partkey, p_partkey % 997 + 1 AS n, CASE WHEN p_size % 3 > 0 THEN p_size END AS a, CASE WHEN p_size % 5 > 0 THEN p_partkey % 60 END AS p FROM part), u AS (SELECT *, CASE WHEN a IS NOT NULL THEN a WHEN p IS NOT NULL THEN p ELSE n // 10 END AS b FROM t), v AS (SELECT *, CASE WHEN p IS NOT NULL THEN p WHEN b > n // 10 THEN b ELSE n // 10 END AS q FROM u) SELECT p_partkey, n, CASE WHEN (CASE WHEN q < b THEN q ELSE b END) > n THEN n ELSE (CASE WHEN q < b THEN q ELSE b END) END AS alignment, CASE WHEN q > n THEN n ELSE q END AS placement FROM v",
    "pairwise_p_distance": f"WITH {SQL_DENSE}, {PAIRS.format(where=NOGAP)} SELECT label, block, a, b, shared, round(d, 6) AS d FROM pr",
    "subset_p_distance": f"WITH {SQL_DENSE}, {PAIRS.format(where=NOGAP)} SELECT label, block, count(*) AS pairs, round(avg(d), 6) AS mean, round(max(d), 6) AS largest FROM pr GROUP BY ALL",
    "p_distance_gap_as_state": f"WITH {SQL_DENSE}, {PAIRS.format(where='')} SELECT label, block, count(*) AS pairs, round(avg(d), 6) AS mean, round(max(d), 6) AS largest FROM pr GROUP BY ALL",
    "hamming_of_neighbours": f"WITH {SQL_DENSE}, nb AS (SELECT label, block, name, lag(name) OVER (PARTITION BY label, block ORDER BY name) AS prev FROM (SELECT DISTINCT label, block, name FROM sites)) SELECT nb.name, round(coalesce(sum(CASE WHEN x.ch <> y.ch THEN 1 ELSE 0 END) FILTER (x.ch <> '-' AND y.ch <> '-') / nullif(count(*) FILTER (x.ch <> '-' AND y.ch <> '-'), 0), 0.0), 6) AS d FROM nb JOIN sites x ON x.label = nb.label AND x.block = nb.block AND x.name = nb.name JOIN sites y ON y.label = nb.label AND y.block = nb.block AND y.name = nb.prev AND y.pos = x.pos GROUP BY nb.name",
    "codon_checks": f"""WITH {SQL_VALUES}, nt AS (SELECT name, string_agg(CASE WHEN x >= 0.08 THEN 'T' WHEN x >= 0 THEN 'C' WHEN x >= -0.08 THEN 'A' ELSE 'G' END, '' ORDER BY pos) AS seq FROM vals GROUP BY name),
cod AS (SELECT name, k, substr(seq, k * 3 + 1, 3) AS codon FROM (SELECT name, seq, unnest(range(0, length(seq) // 3)) AS k FROM nt)),
boxed AS (SELECT *, (instr('TCAG', substr(codon, 1, 1)) - 1) * 16 + (instr('TCAG', substr(codon, 2, 1)) - 1) * 4 AS box FROM cod),
tr AS (SELECT *, substr('{seq.AMINO}', (box + instr('TCAG', substr(codon, 3, 1)))::INT, 1) AS amino, substr('{seq.AMINO}', (box + 1)::INT, 4) AS four FROM boxed),
nx AS (SELECT *, coalesce(lead(amino) OVER (PARTITION BY name ORDER BY k), 'X') AS next_amino FROM tr)
SELECT name, k::INT AS pos, codon, next_amino, substr(codon, 1, 2) || 'N' AS open_codon, next_amino IN ('X', amino) AS fits, four <> repeat(substr(four, 1, 1), 4) AS ambiguous FROM nx""",
    "translated": f"WITH {DNA} SELECT name, k AS pos, codon, amino, true AS fits FROM tr",
    "backtranslate": f"WITH {DNA} SELECT name, string_agg(CASE WHEN (k + name) % 4 = 0 THEN '---' ELSE '' END || codon, '' ORDER BY k) AS seq FROM tr GROUP BY name",
    "model_scores": f"WITH {SCORES} SELECT label, block, name, score FROM sc",
    "routed_rows": f"WITH {SCORES} SELECT name, label, block, score AS bitscore FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, block) AS r FROM sc) WHERE r = 1",
}

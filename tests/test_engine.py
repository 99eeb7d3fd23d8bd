"""Operators on small hand-made or random inputs, against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import sequences as seq
from cladeframe.functions.lineage import materialise
from cladeframe.operators import decompose, distance, merge, placement, profile, routing, sites, splits, trees
from cladeframe.plans import pipelines
from cladeframe.sources import documents, newick, sinks, text
from cladeframe.streaming import routing as stream_routing

rng = random.Random(11)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def trees_df(spark, *texts):
    return materialise(newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id int, newick string")))


# ---------------------------------------------------------------- sources and sinks


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nac-G t\nTT\n>two\n\nGG\n>one x\nA\n")
    (tmp_path / "empty.fa").write_text("")
    assert rows_of(text.fasta(spark, str(tmp_path / "a.fa")), "name", "seq") == [("one x", "A"), ("one x", "AC-GTTT"), ("two", "GG")]
    assert text.fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    assert rows_of(text.alignment(spark, str(tmp_path / "a.fa")), "name", "seq") == [("one x", "A"), ("two", "GG")]
    with pytest.raises(NotImplementedError):
        text.alignment(spark, "x", "nexus")
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    assert text.fasta(spark, str(tmp_path / "bad.fa")).count() == 2  # the leading text is a name of its own, without sequence
    sinks.write(sinks.fasta(spark.createDataFrame([("b", "A-"), ("a", "C")], "name string, seq string")), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == ">a\nC\n>b\nA-\n"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "out"))


def test_other_formats(spark, tmp_path):
    (tmp_path / "m.txt").write_text("(a,b);\n(a,b)[1];\n/p/1\n(b,a);\n/p/2\n\nrest\n")
    main, pairs = text.paired_manifest(text.lines(spark, str(tmp_path / "m.txt")))
    assert main.first().newick == "(a,b);" and rows_of(pairs, "nth", "newick", "path") == [(1, "(a,b)[1];", "/p/1"), (2, "(b,a);", "/p/2")]
    (tmp_path / "t.csv").write_text('"tax_id","parent_id","rank","tax_name"\n"3","1","genus","G, x"\n"1","1","root","root"\n')
    assert rows_of(text.taxonomy(spark, str(tmp_path / "t.csv")), "tax_id", "parent_id", "tax_name") == [("1", "1", "root"), ("3", "1", "G, x")]
    (tmp_path / "map.csv").write_text("seq,tax\na,1\na,3\n")
    assert rows_of(text.mapping(spark, str(tmp_path / "map.csv")), "name", "tax_id") == [("a", "3")]
    (tmp_path / "info.txt").write_text("alpha: 0.5\nrate A <-> C: 1.25\nrate G <-> T: 1.0\nfreq pi(A): 0.3\nFinal GAMMA likelihood: -12.5\nOverall execution time: 3.5\n")
    r = text.model_info(text.lines(spark, str(tmp_path / "info.txt"))).first()
    assert (r.alpha, r.rate_ac, r.rate_gt, r.freq_a, r.final_likelihood, r.time_s) == (0.5, 1.25, 1.0, 0.3, -12.5, 3.5)
    (tmp_path / "log.txt").write_text("x\nWriting resulting alignment to /a\nWriting resulting alignment to /b\nWriting resulting tree to /t\n")
    assert text.logged_paths(text.lines(spark, str(tmp_path / "log.txt"))).first()[1:] == ("/b", "/t")
    (tmp_path / "c.ini").write_text("[commandline]\nmax = 3\nfull\n".replace("full\n", "") + "[tool]\nPath = x\n")
    assert text.config(str(tmp_path / "c.ini")) == (["--max", "3"], {"tool": {"Path": "x"}})
    lengths = text.edge_lengths(spark.createDataFrame([("(a:0.5[0],b:2{1}):1e-3[2];",)], "newick string"))
    assert rows_of(lengths, "edge_num", "length") == [(0, 0.5), (1, 2.0), (2, 0.001)]


def test_lines_and_alignments_of_divided_files(spark, tmp_path, monkeypatch):
    """Files cut to many small blocks have the same lines, and an alignment over them the same rows and columns."""
    from cladeframe.sources import text as source

    r = random.Random(2)
    names, blocks = [f"s{i}" for i in range(40)], []
    for _ in range(6):
        n = r.randint(3, 40)
        blocks.append({x: "".join(r.choice("ACGTacgt.-*") for _ in range(n)) for x in names})
    body = "# STOCKHOLM 1.0\n\n" + "\n\n".join("\n".join(f"{x} {b[x]}" for x in names) for b in blocks) + "\n//\nlate AAA\n"
    (tmp_path / "a.sto").write_text(body)
    (tmp_path / "b.sto").write_text("x AC\ny a-\n")
    monkeypatch.setattr(source, "STRETCH", 16)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = materialise(text.lines(spark, str(tmp_path / "*.sto")).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in got.where("file = 'a.sto'").orderBy("ln").collect()] == body.split("\n")[:-1]
    assert [r.ln for r in got.where("file = 'b.sto'").orderBy("ln").collect()] == [0, 1]
    seqs, cols = text.stockholm(got)
    assert {(r.file, r.name): r.seq for r in seqs.collect()} == {**{("a.sto", x): "".join(b[x] for b in blocks).replace(".", "-") for x in names}, ("b.sto", "x"): "AC", ("b.sto", "y"): "a-"}
    first, want, k = "".join(b["s0"] for b in blocks), [], 0
    for c in first:
        want.append(k if c in "ACGT-" else -1)
        k += c in "ACGT-"
    assert [r.label for r in cols.where("file = 'a.sto'").orderBy("pos").collect()] == want
    assert [r.pos for r in cols.where("file = 'a.sto'").orderBy("pos").collect()] == list(range(len(first)))


def test_search_reports_stay_rows(spark):
    from cladeframe.plans import q_trees

    hit = "1e-5 20.5 0.1 1 2 3 4 1 "
    files = [("a", f"x\n\n E-value score\n --- --- --- --- --- --- --- --- ---\n{hit}n-1\n{hit}n2\n\n{hit}late"), ("b", f"{hit}early\nE-value s\n{hit}n3\nE-value s\n{hit}late"), ("c", "no table"), ("d", f"E-value s\n{hit}n4")]
    got = text.search_hits(text.numbered(spark.createDataFrame(files, "file string, text string")))
    assert rows_of(got, "file", "name", "evalue", "bitscore") == [("a", "n-1", 1e-5, 20.5), ("a", "n2", 1e-5, 20.5), ("b", "n3", 1e-5, 20.5), ("d", "n4", 1e-5, 20.5)]
    plan = q_trees.search_report_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_jplace_round_trip_and_bad_documents(spark):
    p = spark.createDataFrame([("d", "f", 3, -1.0, 0.75, 0.5, 0.25), ("d", "f", 4, -2.0, 0.25, 0.5, 0.25), ("d", "g", 1, -1.0, 1.0, 0.0, 0.0)], "doc_id string, fragment string, edge_num int, likelihood double, lwr double, distal_length double, pendant_length double")
    back = documents.from_jplace(documents.to_jplace(p))
    assert rows_of(back, "doc_id", "fragment", "edge_num", "lwr") == [("d", "f", 3, 0.75), ("d", "f", 4, 0.25), ("d", "g", 1, 1.0)]
    odd = [("x", "{broken"), ("y", '{"tree": "t", "fields": ["like_weight_ratio", "edge_num"], "placements": [{"p": [[0.5, 7]], "nm": [["q", "2"]]}]}'), ("z", '{"placements": [], "fields": []}')]
    assert rows_of(documents.from_jplace(spark.createDataFrame(odd, "doc_id string, json string")), "doc_id", "fragment", "edge_num", "lwr", "copies") == [("y", "q", 7, 0.5, 2.0)]


# ---------------------------------------------------------------- sequences and sites


def test_codons(spark):
    code = seq.genetic_code()
    assert len(code) == 64 and code["ATG"] == "M" and code["TAA"] == "_" and code["TGG"] == "W" and code["GGG"] == "G"
    df = spark.createDataFrame([("ATG", "M"), ("GAN", "D"), ("GAN", "Z"), ("RAY", "B"), ("TTN", "X"), ("AT", "M"), ("A?G", "M"), ("ATG", "L")], "c string, a string")
    got = [tuple(r) for r in df.select("c", "a", seq.is_compatible("c", "a"), seq.is_ambiguous("c")).collect()]
    assert [g[2] for g in got] == [True, True, True, True, True, False, False, False] and [g[3] for g in got] == [False, True, True, True, True, False, False, False]


def test_backtranslate_errors_and_start_codons(spark):
    mk = lambda rows: spark.createDataFrame(rows, "name string, seq string")
    assert rows_of(seq.backtranslate(mk([("a", "M-K")]), mk([("a", "GTGAAAC"), ("z", "A")])), "name", "seq") == [("a", "GTG---AAA")]
    for p, d in (("MK", "ATGCCC"), ("MK", "ATGAA"), ("KM", "AAAGTG")):
        with pytest.raises(Exception, match="no codon"):
            seq.backtranslate(mk([("a", p)]), mk([("a", d)])).collect()


def test_hamming_names_and_bits(spark):
    df = spark.createDataFrame([("ac-t", "AG-A"), ("----", "ACGT"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(seq.hamming("a", "b")).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]
    with pytest.raises(Exception, match="shorter"):
        spark.createDataFrame([("ACG", "A")], "a string, b string").select(seq.hamming("a", "b")).collect()
    n = spark.createDataFrame([("s_x_1_2_3_500000",)], "n string").select(seq.renamed("n"), seq.prior("n")).first()
    assert tuple(n) == ("s_x", 0.5)
    e = spark.createDataFrame([("a:1[12]",), ("b{3}",), ("c",)], "t string").select(seq.edge_number("t"))
    assert [r[0] for r in e.collect()] == [12, 3, None]
    b = spark.createDataFrame([([5, 1], [4, 1])], "a array<bigint>, b array<bigint>")
    assert tuple(b.select(seq.bits_count("a"), seq.bits_contain("a", "b"), seq.bits_xor("a", "b")).first()) == (3, True, [1, 0])
    assert seq.gcd(12, 18) == 6 and seq.lcm(4, 6) == 12 and routing.chunks_per_subset(6, 4) == 2


def test_site_operators_match_python(spark):
    names = [f"n{i}" for i in range(6)]
    aln = {n: "".join(rng.choice("A--") for _ in range(12)) for n in names}
    aln[names[0]] = "A" + aln[names[0]][1:]
    s = sites.to_sites(spark.createDataFrame(list(aln.items()), "name string, seq string"))
    keep = [i for i in range(12) if any(v[i] != "-" for v in aln.values())]
    assert dict(rows_of(sites.to_rows(sites.delete_all_gap(s)), "name", "seq")) == {n: "".join(v[i] for i in keep) for n, v in aln.items()}
    runs = rows_of(sites.islands(spark.createDataFrame([(p,) for p in (0, 1, 2, 5, 7, 8)], "pos int")), "first", "last")
    assert runs == [(0, 2), (5, 5), (7, 8)]
    with pytest.raises(Exception, match="differ"):
        sites.relabel(spark.createDataFrame([(0, 0), (1, 1)], "pos int, label int"), spark.createDataFrame([(0, 9)], "nth int, label int")).collect()


def two_pointer(a, b):
    """Reference rule for merging two label lists; originals ascend, insertions are negative."""
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        ia, ib = i < len(a) and a[i] < 0, j < len(b) and b[j] < 0
        if ia and ib:
            out.append(-1), (i := i + 1), (j := j + 1)
        elif ib:
            out.append(-1), (j := j + 1)
        elif ia:
            out.append(-1), (i := i + 1)
        elif j >= len(b) or (i < len(a) and a[i] < b[j]):
            out.append(a[i]), (i := i + 1)
        elif i >= len(a) or a[i] > b[j]:
            out.append(b[j]), (j := j + 1)
        else:
            out.append(a[i]), (i := i + 1), (j := j + 1)
    return out


def test_merge_matches_the_two_pointer_rule(spark):
    cases, want = [], {}
    for case in range(40):
        lists = []
        for part in range(rng.randint(2, 4)):
            labels = sorted(rng.sample(range(8), rng.randint(1, 6)))
            mixed = []
            for x in [*labels, None]:
                mixed += [-1] * rng.choice([0, 0, 1, 2])
                mixed += [x] if x is not None else []
            lists.append(mixed)
            cases += [(case, part, p, x) for p, x in enumerate(mixed)]
        merged = lists[0]
        for other in lists[1:]:
            merged = two_pointer(merged, other)
        want[case] = merged
    co = merge.coordinates(spark.createDataFrame(cases, "grp int, part int, pos int, label int"), ["grp", "part"])
    got = {}
    for r in merge.merged_columns(co.select("grp", "anchor", "ord").distinct(), ["grp"]).orderBy("grp", "pos").collect():
        got.setdefault(r.grp, []).append(r.anchor if r.ord == 0 else -1)
    assert got == want


def test_merged_rows_render(spark):
    s = [(0, "a", 0, "A", 0, 0), (0, "a", 1, "C", 0, 1), (0, "a", 2, "G", 1, 0), (1, "b", 0, "T", 1, 0), (1, "a", 0, "X", 1, 0)]
    df = spark.createDataFrame(s, "input int, name string, pos int, ch string, anchor int, ord int")
    cols = merge.merged_columns(df.select("anchor", "ord").distinct())
    assert rows_of(merge.render(merge.merge(df.drop("pos"), "input"), cols), "name", "seq") == [("a", "ACG"), ("b", "--T")]
    assert merge.mixed_columns(df, "input").first().mixed == 0


# ---------------------------------------------------------------- routing


def test_routing_rules(spark):
    hits = spark.createDataFrame([("f", "b", 2.0, 0.1), ("f", "a", 2.0, 0.2), ("g", "a", 1.0, 0.1), ("h", "a", None, None)], "fragment string, subset string, bitscore double, evalue double")
    assert rows_of(routing.best_hit(hits, ["subset"]), "fragment", "subset") == [("f", "a"), ("g", "a")]
    assert rows_of(routing.unscored(hits, hits), "fragment") == [("h",)]
    assert {r.fragment: len(r.scores) for r in routing.all_scores(hits, hits).collect()} == {"f": 2, "g": 1, "h": 0}
    assert routing.chunk_count(100, 4, 20) == 6 and routing.chunk_count(100, 4, 30) == 4
    q = spark.createDataFrame([("a", "A-C"), ("b", "AC")], "name string, seq string")
    with pytest.raises(ValueError):
        routing.without_collisions(q, q.where("name = 'a'"))
    assert rows_of(routing.without_collisions(q, q.where("name = 'a'"), ignore=True), "name") == [("b",)]
    assert rows_of(routing.with_extra(q.where("name = 'b'"), q.where("name = 'a'")), "name", "seq") == [("a", "AC"), ("b", "AC")]


def test_length_quantile(spark):
    for lengths in ([5], [1, 9], [3, 3, 8, 9], [1, 2, 3, 4, 5], [7] * 6):
        df = spark.createDataFrame([("x" * n,) for n in lengths], "seq string")
        s = sorted(lengths)
        for q in (-1, 0.25, 0.9):
            i = int(len(s) * (0.5 if q == -1 else q))
            want = s[i] if len(s) % 2 or i == len(s) - 1 else (s[i] + s[i + 1]) / 2
            assert routing.length_quantile(df, q).first().length == want
    assert routing.length_quantile(df, 40).first().length == 40


def test_size_rule():
    assert routing.size_rule(100) == (10, 10) and routing.size_rule(100, alignment=20) == (20, 20)
    assert routing.size_rule(100, placement=50) == (50, 50) and routing.size_rule(100, 30, 20) == (20, 20) and routing.size_rule(5, 30, 60) == (5, 5)


# ---------------------------------------------------------------- trees


def random_newick(n):
    parts = [f"t{i}:{rng.randint(1, 9) / 10}" for i in range(n)]
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 2, 3]))
        picked = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append("(" + ",".join(picked) + ")" + (f":{rng.randint(1, 9) / 10}" if parts else ""))
    return parts[0] + ";"


def plain_tree(nodes):
    """{leaf: {ancestor: distance}} of one tree's rows, by following parents."""
    by = {r.node_id: r for r in nodes}
    out = {}
    for r in nodes:
        if r.is_leaf:
            d, at, up = 0.0, r, {r.node_id: 0.0}
            while at.parent_id is not None:
                d += at.length or 0
                up[at.parent_id] = d
                at = by[at.parent_id]
            out[r.name] = up
    return out


def test_newick_details(spark):
    t = trees_df(spark, "('a b':1,(c_d:2.5,'it''s[5]':3)0.9:4[7],e)root;", "[&U](x,y);", "lone;", "((a:1,b:1):1:88,c:1{3});")
    r = {(x.tree_id, x.name): x for x in t.collect()}
    assert r[0, "a b"].length == 1 and r[0, "it's[5]"].edge_num is None and r[0, "0.9"].support == 0.9 and r[0, "0.9"].edge_num == 7
    assert r[0, "root"].parent_id is None and r[0, "e"].child_ord == 2 and r[0, "c_d"].parent_id == r[0, "0.9"].node_id
    assert not r[1, "x"].rooted and r[2, "lone"].parent_id is None and r[3, "c"].edge_num == 3
    assert [x.support for x in t.where("tree_id = 3 and not is_leaf and parent_id is not null").collect()] == [88.0]
    again = newick.parse(newick.write(t, labels=True, edge="edge_num"))
    assert rows_of(again.select("tree_id", "node_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("length", F.lit(-1.0)).alias("length")), "tree_id", "node_id", "name", "length") == rows_of(t.select("tree_id", "node_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("length", F.lit(-1.0)).alias("length")), "tree_id", "node_id", "name", "length")
    bad = newick.faults(spark.createDataFrame([(0, "((a,b);"), (1, "(a,a);"), (2, "(a,'(');")], "tree_id int, newick string"))
    assert rows_of(bad, "tree_id", "fault") == [(0, "unbalanced brackets"), (1, "duplicate name a")]


def test_tree_operators_match_python(spark):
    texts = [random_newick(n) for n in (2, 5, 9, 17)]
    t = trees_df(spark, *texts)
    d = {(r.tree_id, *sorted((r.a, r.b))): r.d for r in trees.leaf_distances(t).collect()}
    diam = {r.tree_id: r.diameter for r in trees.diameter(t).collect()}
    mids = {r.tree_id: r.diameter for r in trees.midpoint_edge(t).collect()}
    for tid in range(4):
        nodes = t.where(F.col("tree_id") == tid).collect()
        ids = {r.name: r.node_id for r in nodes if r.is_leaf}
        up = plain_tree(nodes)
        want = {}
        for a, b in itertools.combinations(ids, 2):
            want[tid, *sorted((ids[a], ids[b]))] = min(up[a][x] + up[b][x] for x in up[a] if x in up[b])
        assert {k: v for k, v in d.items() if k[0] == tid} == pytest.approx(want)
        assert diam[tid] == pytest.approx(max(want.values())) and mids[tid] == pytest.approx(max(want.values()))
    keep = t.where("is_leaf and name in ('t0', 't1', 't3')").select("tree_id", "name")
    p = materialise(trees.prune(t.where("tree_id = 3"), keep.where("tree_id = 3")))
    assert sorted(r.name for r in p.where("is_leaf").collect()) == ["t0", "t1", "t3"]
    ids = {r.name: r.node_id for r in t.where("tree_id = 3 and is_leaf").collect()}
    small = {r.name: r.node_id for r in p.where("is_leaf").collect()}
    pd = {tuple(sorted((r.a, r.b))): r.d for r in trees.leaf_distances(p).collect()}
    for a, b in itertools.combinations(small, 2):
        assert pd[tuple(sorted((small[a], small[b])))] == pytest.approx(d[3, *sorted((ids[a], ids[b]))])
    r = materialise(trees.resolve_polytomies(t))
    assert all(x.binary for x in trees.is_binary(r).collect())
    assert {x.tree_id: x.diameter for x in trees.diameter(r).collect()} == pytest.approx(diam)


def test_collapse_low_support(spark):
    t = trees_df(spark, "(((a:1,b:1)0.2:2,c:1)0.9:3,d:1);")
    k = trees.collapse_low_support(t, 0.5)
    assert rows_of(newick.write(k), "newick") == [("((a:3.0,b:3.0,c:1.0):3.0,d:1.0);",)]


def test_decomposition_invariants(spark):
    t = trees_df(spark, random_newick(40), random_newick(7))
    for strategy in ("centroid", "longest", "midpoint"):
        got = decompose.decompose(t, 8, strategy, least=2).collect()
        for tid, n in ((0, 40), (1, 7)):
            own = [r for r in got if r.tree_id == tid]
            assert len({r.name for r in own}) == len(own) == n
            sizes = {s: sum(r.subset == s for r in own) for s in {r.subset for r in own}}
            assert min(sizes.values()) >= 2 and (max(sizes.values()) <= 8 or strategy != "centroid")
    nested = decompose.decompose(t, 8, nested=True)
    assert nested.where("tree_id = 0 and subset = ''").count() == 40 and nested.where("tree_id = 1").count() == 7


def test_splits(spark):
    a, b = trees_df(spark, "((a,b),(c,(d,e)));"), trees_df(spark, "(a,(b,(c,(e,d))));")
    assert tuple(splits.shared_splits(a, b).first()) == (0, 2, 0, 0)
    assert not splits.same_topology(a, b).first().same and splits.same_leaves(a, b).first().same
    assert splits.incompatible_clusters(a, b).first().incompatible == 1
    old = trees_df(spark, "(((a,b)X,c)Y,(d,e)Z);")
    named = splits.transfer_labels(old, a).where("not is_leaf and name is not null")
    assert sorted(r.name for r in named.collect()) == ["X", "X", "Y"]  # Y and Z are one split; the first name counts
    taxa = spark.createDataFrame([(0, x) for x in "abcd"], "set_id int, name string")
    assert splits.all_clusters(taxa).select("cluster_id").distinct().count() == 10
    clades = splits.shared_clades(a, b)
    small, undo = splits.collapse(a, clades)
    assert rows_of(small.where("is_leaf"), "name") == [("__c_d_e",), ("a",), ("b",)] and rows_of(undo, "leaf") == [("c",), ("d",), ("e",)]


def test_cluster_algebra(spark):
    from cladeframe.functions import clusters as c

    df = spark.createDataFrame([(["a", "b"], ["b", "a", "c"], ["c", "d"], list("abcd"), [["c"], ["d"]])], "x array<string>, y array<string>, z array<string>, t array<string>, l array<array<string>>")
    got = df.select(c.cluster("y"), c.compatible("x", "y"), c.compatible("y", "z"), c.complement("x", "t"), c.complementary("x", "z", "t"), c.is_branch("x", c.cluster("y"), "l"), c.merged("x", "z"), c.same_split("x", "z", "z", "x")).first()
    assert tuple(got) == (["a", "b", "c"], True, False, ["c", "d"], True, True, ["a", "b", "c", "d"], True)
    bits = spark.createDataFrame([([3], [6]), ([3], [7]), ([3], [12])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in bits.select(c.compatible_bits("a", "b", 5)).collect()] == [False, True, True]


def test_tree_checks(spark):
    t = trees_df(spark, "((a,b),c);", "[&U](a,b);", "((a)x,b);")
    assert rows_of(trees.sane(t), "tree_id", "fault") == [(1, "unrooted tree with two root children"), (2, "unary node")]
    assert rows_of(trees.unary(t), "name") == [("x",)]
    assert rows_of(trees.unmapped_leaf(t, spark.createDataFrame([("a",)], "name string")), "tree_id", "name") == [(0, "b"), (1, "b"), (2, "b")]
    assert trees.random_node(t, 3, leaves=False, root=False).count() == 2


# ---------------------------------------------------------------- placements


def test_document_merge_and_clip(spark):
    main = trees_df(spark, "(a:1[0],(b:1[1],c:2[2]):1[3],d:1[4]);")
    own = materialise(newick.parse(spark.createDataFrame([("x", "(b:1[5],c:1[6],(d:1[7],a:1[8]):1[9]);")], "tree_id string, newick string")))
    p = spark.createDataFrame([("x", "f", 9, 0.5, 0.4), ("x", "f", 6, 0.5, 9.0)], "doc_id string, fragment string, edge_num int, lwr double, distal_length double")
    got = placement.merge_documents(p, own, main)
    assert rows_of(got, "edge_num", "distal_length") == [(2, pytest.approx(1.98)), (3, 0.4)]
    with pytest.raises(Exception, match="partner"):
        placement.merge_documents(p.withColumn("edge_num", F.lit(77)), own, main).collect()


def test_classification_and_insertion_tree(spark):
    main = trees_df(spark, "((a:1[0],b:1[1]):1[2],c:1[3])root;")
    taxa = spark.createDataFrame([("1", None, "root", "R"), ("2", "1", "genus", "G"), ("3", "2", "species", "A"), ("4", "2", "species", "B"), ("5", "1", "species", "C")], "tax_id string, parent_id string, rank string, tax_name string")
    mapping = spark.createDataFrame([("a", "3"), ("b", "4"), ("c", "5")], "name string, tax_id string")
    p = spark.createDataFrame([("f", 0, 0.5, 1.0), ("f", 1, 0.5, 1.0), ("g", 2, 1.0, 1.0)], "fragment string, edge_num int, lwr double, prior double")
    got = placement.classify(p, main, taxa, mapping)
    assert rows_of(got, "fragment", "id") == [("f", "1"), ("f", "2"), ("g", "1"), ("g", "2")]
    loop = spark.createDataFrame([("1", "2"), ("2", "1")], "tax_id string, parent_id string")
    with pytest.raises(ValueError, match="root"):
        placement.taxonomy_closure(loop)
    q = spark.createDataFrame([("f", 0, 0.9, 0.25, 0.1), ("g", 0, 0.9, 0.5, 0.2)], "fragment string, edge_num int, lwr double, distal_length double, pendant_length double")
    t = materialise(trees.from_parents(placement.insertion_tree(main, q)))
    assert sorted(r.name for r in t.where("is_leaf").collect()) == ["a", "b", "c", "f", "g"]
    ids = {r.name: r.node_id for r in t.where("is_leaf").collect()}
    d = {tuple(sorted((r.a, r.b))): r.d for r in trees.leaf_distances(t).collect()}
    assert d[tuple(sorted((ids["a"], ids["b"])))] == pytest.approx(2.0) and d[tuple(sorted((ids["a"], ids["f"])))] == pytest.approx(0.35)


# ---------------------------------------------------------------- profiles and pipelines


def brute_align(s, w, alphabet, open_=4.0, extend=1.0):
    """Best score by trying every path, by memoised recursion over (residue, site, state)."""
    from functools import cache

    n, m = len(s), len(w)

    @cache
    def go(i, j, state):
        if i == n and j == m:
            return 0.0
        best = -1e30
        if i < n and j < m:
            best = max(best, w[j][alphabet.index(s[i])] + go(i + 1, j + 1, "m"))
        if i < n:
            best = max(best, (-extend if state == "i" else -open_) + go(i + 1, j, "i"))
        if j < m:
            best = max(best, (-extend if state == "d" else -open_) + go(i, j + 1, "d"))
        return best

    return go(0, 0, "m")


def test_rollup_adds_shares_alike_in_any_order(spark):
    """Three shares of 0.699995 together: which double their sum is must not depend on the order of rows."""
    p = [0.1, 0.2, 0.399995]
    rows = [(k, f"s{i}", p[i]) for k, order in enumerate(itertools.permutations(range(3))) for i in order]
    rows += [(9, "s0", float("inf")), (9, "s1", 0.5), (10, "s0", None), (11, "s0", 1e30), (11, "s1", 1e30)]
    closure = spark.createDataFrame([(f"s{i}", "r") for i in range(3)], "tax_id string, anc string")
    shares = spark.createDataFrame(rows, "fragment int, tax_id string, p double").coalesce(1)
    got = dict(rows_of(placement.rollup(shares, closure, None), "fragment", "p"))
    assert {got.pop(k) for k in range(6)} == {math.fsum(p)}
    assert got == {9: float("inf"), 10: None, 11: 2e30}


def test_scores_meet_packed_rows_not_their_sites(spark):
    """Rows and models of several alignments against plain sums; only packed rows and models are joined and shuffled."""
    r = np.random.default_rng(3)
    site = [(int(a), f"n{i}", int(p), str(r.choice(list("ACGT-")))) for a in range(2) for i in range(30) for p in r.choice(9, r.integers(0, 9), replace=False)]
    site += [(0, "twice", 1, "A"), (0, "twice", 1, "A"), (0, "else", 5000000, "C"), (0, None, 2, "A"), (None, "n1", 1, "A"), (7, "alone", 1, "A")]
    model = [(int(a), int(b), int(p), c, float(r.normal())) for a in range(2) for b in range(7) for p in r.choice(9, 4, replace=False) for c in "ACGT"]
    model += [(0, 8, 5000000, "C", float("-inf")), (0, 9, 0, "A", 1.0), (9, 1, 1, "A", 1.0)]
    got = profile.score(spark.createDataFrame(site, "label int, name string, pos int, ch string"), spark.createDataFrame(model, "label int, block int, pos int, ch string, w double"), ["label"], ["block"])
    assert "ch#" not in "".join(line for line in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "Join" in line or "Exchange" in line)
    want = {}
    for a, name, p, c in site:
        for b, k, q, d, w in model:
            if c != "-" and a is not None and (a, p, c) == (b, q, d):
                want[a, k, name] = want.get((a, k, name), 0.0) + w
    have = {(x["label"], x["block"], x["name"]): x["score"] for x in got.collect()}
    assert have == pytest.approx(want) and got.count() == len(want)
    best = profile.score(spark.createDataFrame(site, "label int, name string, pos int, ch string"), spark.createDataFrame(model, "label int, block int, pos int, ch string, w double"), ["label"], ["block"], within=0.0)
    top = {(a, name): max(v for (b, _, m), v in want.items() if (b, m) == (a, name)) for a, _, name in want}
    assert {(x["label"], x["name"]): x["score"] for x in best.collect()} == pytest.approx(top)
    assert profile.score(spark.createDataFrame([("x", 0, "A")], "name string, pos int, ch string"), spark.createDataFrame([(1, 0, "A", 2.0)], "block int, pos int, ch string, w double"), [], ["block"]).collect() == [(1, "x", 2.0)]


def test_scores_of_a_part_do_not_depend_on_what_else_is_in_it():
    """Models of so many different sites that a part is scored in slices; rows of any length, and none."""
    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(60000, n, replace=False)) for n in (0, 1, 40, 700, 3)]
    models = [np.sort(r.choice(60000, 600, replace=False)) for _ in range(150)]
    w = [r.normal(size=600) for _ in models]
    flat = lambda x: (np.array([len(a) for a in x]), np.concatenate(x) if x else np.zeros(0, int))
    assert len(np.unique(flat(models)[1])) * 150 > 1 << 22
    got = {(i, j): x for i, j, x in zip(*profile.tile_scores(*flat(rows), *flat(models), np.concatenate(w), None))}
    one = {(i, j): x for i, a in enumerate(rows) for j, b in enumerate(models) for *_, x in zip(*profile.tile_scores(*flat([a]), *flat([b]), w[j], None))}
    assert got == one and len(got) > 150
    assert got == pytest.approx({(i, j): w[j][np.isin(models[j], rows[i])].sum() for i, j in got})
    assert [len(c) for c in profile.tile_scores(*flat(rows), np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1.0)] == [0, 0, 0]


def test_viterbi_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(40):
        w = r.normal(0, 2, (r.integers(1, 7), 4))
        s = "".join(r.choice(list("ACGT"), r.integers(1, 7)))
        score, path = profile.viterbi(s, w, "ACGT")
        assert score == pytest.approx(brute_align(s, w.tolist(), "ACGT")) and len(path) == len(s)
        on = [p for p in path if p >= 0]
        assert on == sorted(set(on))


def test_viterbi_holds_a_byte_for_a_cell():
    import tracemalloc

    r = np.random.default_rng(6)
    w, s = r.normal(0, 2, (1200, 4)), "".join(r.choice(list("ACGT"), 1200))
    tracemalloc.start()
    _, path = profile.viterbi(s, w, "ACGT")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 1200 and peak < 8e6  # three tables of doubles take 35 MB


def test_fragments_of_a_popular_model_are_aligned_in_parts(spark):
    """A part meets its model once; no fragment's row carries the model. Rows as of one fragment at a time."""
    r = np.random.default_rng(7)
    frag = [("pop", f"n{i}", "".join(r.choice(list("ACGTN"), r.integers(0, 12)))) for i in range(4500)] + [("few", "a", "ACG"), ("none", "b", "ACG"), (None, "c", "ACG"), ("few", "a", "ACG")]
    w = {"pop": r.normal(0, 2, (8, 4)), "few": r.normal(0, 2, (3, 4)), "idle": r.normal(0, 2, (2, 4))}
    model = [(k, 10 * p, "ACGT"[c], float(x[p, c])) for k, x in w.items() for p in range(len(x)) for c in range(4)]
    got = profile.align(spark.createDataFrame(frag, "key string, name string, seq string"), spark.createDataFrame(model, "key string, pos int, ch string, w double"), "key")
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "CoGroups" in plan and "MapInPandas" not in plan
    want = []
    for k, name, seq in frag:
        if k in w:
            score, path = profile.viterbi(seq, w[k], "ACGT")
            want += [(k, name, score, i, 10 * p if p >= 0 else -1) for i, p in enumerate(path)]
    assert rows_of(got, "key", "name", "score", "pos", "site") == sorted(want)


def test_pipelines_end_to_end(spark):
    r = np.random.default_rng(5)
    root = r.choice(list("ACGT"), 60)
    half = [root.copy() for _ in range(2)]
    half[1][:30] = r.choice(list("ACGT"), 30)
    rows = []
    for i in range(12):
        s = half[i // 6].copy()
        s[r.integers(0, 60, 3)] = "A"
        rows.append((f"t{i}", "".join(s)))
    backbone = spark.createDataFrame(rows, "name string, seq string")
    side = lambda k: "(" + ",".join(f"t{i}:0.1" for i in range(6 * k, 6 * k + 6)) + "):1"
    tree = trees_df(spark, f"({side(0)},{side(1)});").drop("tree_id").withColumn("tree_id", F.lit(0))
    tree = materialise(tree)
    queries = spark.createDataFrame([("q0", rows[1][1][10:50].lower()), ("q1", rows[8][1][:40])], "name string, seq string")
    o = pipelines.Options(alignment_size=6, placement_size=12).check()
    scored = {x.fragment: len(x.scores) for x in pipelines.score_families(queries, backbone, tree, o).collect()}
    assert scored == {"q0": 2, "q1": 2}
    aligned, cols = pipelines.align_queries(queries, backbone, tree, o)
    full = {x.name: x.seq for x in merge.render(materialise(aligned).join(cols, ["anchor", "ord"]), cols).collect()}
    assert len(full) == 14 and len({len(v) for v in full.values()}) == 1
    assert full["q0"].replace("-", "") == rows[1][1][10:50] and full["q1"].replace("-", "") == rows[8][1][:40]
    placed = pipelines.place_queries(queries, backbone, tree, o, keep=3)
    best = {x.fragment: x.edge_num for x in placement.best(placed).collect()}
    leaf = {x.node_id: x.name for x in tree.where("is_leaf").collect()}
    assert int(leaf[best["q0"]][1:]) < 6 <= int(leaf[best["q1"]][1:])
    with pytest.raises(ValueError, match="white space"):
        pipelines.checked_queries(spark.createDataFrame([("a b", "A")], "name string, seq string"), backbone, o)
    with pytest.raises(ValueError):
        pipelines.Options().with_({"strategy": "best"})
    assert pipelines.Options().with_({"seed": 1}, {"seed": 2}).seed == 2


def test_external_program(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "key string, value string")
    got = pipelines.external(df, "key", ["sort", "-r"], lambda k, out: [(k, v) for v in out.split()], "key string, value string")
    assert rows_of(got, "key", "value") == [("a", "x"), ("a", "y"), ("b", "z")]
    with pytest.raises(Exception, match="failed"):
        pipelines.external(df, "key", ["false"], lambda k, out: [], "key string, value string").collect()


def test_distances_within_subsets(spark):
    s = sites.to_sites(spark.createDataFrame([(0, "a", "AC"), (0, "b", "AG"), (0, "c", "--")], "grp int, name string, seq string"))
    d = materialise(distance.pairs(s, ["grp"]))
    assert rows_of(d, "a", "b", "d") == [("a", "b", 0.5), ("a", "c", 0.0), ("b", "c", 0.0)] and distance.both_ways(d, ["grp"]).count() == 6
    assert distance.within(d, spark.createDataFrame([("a",), ("b",)], "name string"), "max").first().d == 0.5


def test_stream_of_hits(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    hits = spark.createDataFrame([("f", "b", 2.0), ("f", "a", 2.0), ("g", "a", 1.0)], "fragment string, subset string, bitscore double")
    hits.write.parquet(src)
    q = stream_routing.best_hits(spark.readStream.schema(hits.schema).parquet(src)).writeStream.format("memory").queryName("best").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows_of(spark.table("best"), "fragment", "subset") == rows_of(routing.best_hit(hits, ["subset"]), "fragment", "subset")


# ---------------------------------------------------------------- registered queries


def test_oracles_have_queries_and_agree(spark):
    import duckdb

    from cladeframe.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in ("best_hit_routing", "compact_subsets", "extended_merge", "subset_p_distance", "centroid_edge", "split_relabel", "placement_threshold", "taxonomic_rollup"):
        df = catalog.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = df.toPandas()[cols].sort_values(cols, ignore_index=True)
        want = con.sql(catalog.ORACLES[name]).df()[cols].sort_values(cols, ignore_index=True)
        assert len(got) == len(want)
        for c in cols:
            a, b = got[c].to_numpy(), want[c].to_numpy()
            assert np.allclose(a.astype(float), b.astype(float), atol=2e-6, equal_nan=True) if a.dtype.kind in "fi" else (a == b).all(), (name, c)

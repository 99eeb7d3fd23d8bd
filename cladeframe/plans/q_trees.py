"""Queries on trees, splits, placements and taxonomies, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.functions.ordinals import ordinal
from cladeframe.operators import decompose, placement, resolutions, splits, trees
from cladeframe.sources import documents, newick

from .fixtures import SQL_DENSE, SQL_DIST, SQL_LEAVES, forest, forests, placements, sql_tree, table

def _id():
    return [F.col("tree_id.label").alias("label"), F.col("tree_id.block").alias("block")]


def _named(nodes, found, *cols):
    """found (tree_id, node_id, …) with the heap node in place of node_id."""
    back = nodes.select("tree_id", "node_id", "node")
    return found.join(back, ["tree_id", "node_id"]).select(*_id(), "node", *cols)


def edge_leaf_counts(spark, d):
    return trees.leaf_counts(forest(spark, d)).select(*_id(), "node", "leaves", "total")


def root_distances(spark, d):
    return trees.root_distance(forest(spark, d)).select(*_id(), "node", F.round("dist", 6).alias("dist"), "depth")


def centroid_edge(spark, d):
    n = forest(spark, d)
    return _named(n, trees.breaking_edge(n, "centroid", 2), "leaves", "total")


def longest_edge(spark, d):
    n = forest(spark, d)
    return _named(n, trees.breaking_edge(n, "longest", 2), "leaves")


def clade_edge(spark, d):
    n = forest(spark, d)
    return _named(n, trees.breaking_edge(n, "clade"), "leaves")


def product_edge(spark, d):
    n = forest(spark, d)
    return _named(n, trees.heaviest_path_edge(n), "leaves", "total")


def bisected_leaves(spark, d):
    n = forest(spark, d)
    return trees.bipartition(n, trees.breaking_edge(n, "centroid", 2)).select(*_id(), "name", "below")


def adjacent_edges(spark, d):
    n = forest(spark, d)
    a = trees.adjacent_edges(n)
    x, y = n.select("tree_id", F.col("node_id").alias("edge"), F.col("node").alias("a")), n.select("tree_id", F.col("node_id").alias("other"), F.col("node").alias("b"))
    return a.join(x, ["tree_id", "edge"]).join(y, ["tree_id", "other"]).select(*_id(), "a", "b")


def leaf_distance(spark, d):
    n = forest(spark, d)
    got = trees.leaf_distances(n)
    x, y = n.select("tree_id", F.col("node_id").alias("a"), F.col("name").alias("x")), n.select("tree_id", F.col("node_id").alias("b"), F.col("name").alias("y"))
    pairs = got.join(x, ["tree_id", "a"]).join(y, ["tree_id", "b"])
    return pairs.select(*_id(), F.least(F.col("x").cast("long"), F.col("y").cast("long")).alias("a"), F.greatest(F.col("x").cast("long"), F.col("y").cast("long")).alias("b"), F.round("d", 6).alias("d"))


def tree_diameter(spark, d):
    return trees.diameter(forest(spark, d)).select(*_id(), F.round("diameter", 6).alias("diameter"))


def nearest_taxa(spark, d):
    n = forest(spark, d)
    got = trees.nearest_taxa(n, 3)
    x = n.select("tree_id", F.col("node_id").alias("a"), F.col("name").alias("x"))
    return got.join(x, ["tree_id", "a"]).select(*_id(), F.col("x").cast("long").alias("name"), "rank", F.round("d", 6).alias("d"))


def lca_pairs(spark, d):
    n = forest(spark, d)
    w = Window.partitionBy("tree_id").orderBy("node_id")
    pairs = n.where("is_leaf").withColumn("a", F.lag("node_id", 3).over(w)).where("a is not null").select("tree_id", "a", F.col("node_id").alias("b"))
    got = trees.lca_pairs(n, pairs)
    m = n.select("tree_id", "node_id", "node", "name")
    y = got.join(m.select("tree_id", F.col("node_id").alias("b"), F.col("name").alias("leaf")), ["tree_id", "b"])
    return y.join(m.select("tree_id", F.col("node_id").alias("lca"), "node"), ["tree_id", "lca"]).select(*_id(), F.col("leaf").cast("long").alias("name"), "node")


def lca_of_sets(spark, d):
    n = forest(spark, d)
    sets = n.where("is_leaf").select("tree_id", (F.col("name").cast("long") % 7).alias("set_id"), "node_id")
    got = trees.lca_set(n, sets)
    return got.join(n.select("tree_id", F.col("node_id").alias("lca"), "node"), ["tree_id", "lca"]).select(*_id(), "set_id", "node")


def long_branches(spark, d):
    return trees.long_branches(forest(spark, d), 3.0).select(*_id(), F.col("name").cast("long").alias("name"), "length", "median")


def pruned_trees(spark, d):
    n = forest(spark, d)
    keep = n.where("is_leaf and cast(name as long) % 3 <> 0").select("tree_id", "name")
    p = materialise(trees.prune(n, keep))
    dist = trees.root_distance(p)
    return dist.where("is_leaf").select(*_id(), F.col("name").cast("long").alias("name"), "depth", F.round("length", 6).alias("length"))


def binary_trees(spark, d):
    return trees.is_binary(forest(spark, d)).select(*_id(), "binary")


def scaled_lengths(spark, d):
    return trees.scale(forest(spark, d), 2.5).select(*_id(), "node", "length")


def labelled_nodes(spark, d):
    n = trees.auto_label(forest(spark, d))
    return n.groupBy(*_id()).agg(F.count_distinct("name").alias("names"), F.sum(F.col("name").startswith("I").cast("long")).alias("fresh"))


def newick_round_trip(spark, d):
    n = forest(spark, d)
    again = newick.parse(newick.write(n))
    return again.where("is_leaf").select(*_id(), F.col("name").cast("long").alias("name"), F.col("leaf_lo").alias("rank"), F.round("length", 6).alias("length"))


def split_relabel(spark, d):
    """Edges of the tree over ranks by id, matched to those of the same block's tree over ranks by first component."""
    a, b = forests(spark, d, "vec_id", "x0")
    moved = splits.relabel_edges(numbered(a), numbered(b))
    return moved.select(*_id(), F.pmod("edge_num", F.lit(4096)).cast("int").alias("node"), F.pmod("to_edge", F.lit(4096)).cast("int").alias("other"))


def numbered(nodes):
    """Edge numbers over a whole forest: the tree's label and block, and the heap node below the edge (under 2 * 640)."""
    num = (F.col("tree_id.label").cast("long") * 1_000_000 + F.col("tree_id.block")) * 4096 + F.col("node")
    return nodes.withColumn("edge_num", F.when(F.col("parent_id").isNotNull(), num))


def merged_placements(spark, d):
    """Every leaf placed on its own edge of the tree by id, moved to the tree by first component, distal lengths clipped."""
    a, b = map(numbered, forests(spark, d, "vec_id", "x0"))
    p = a.where("is_leaf and edge_num is not null").select(F.col("tree_id").alias("doc_id"), F.col("name").cast("long").alias("fragment"), "edge_num", F.lit(0.1).alias("distal_length"))
    got = placement.merge_documents(p, a, b)
    return got.select("doc_id.label", "doc_id.block", "fragment", F.pmod("edge_num", F.lit(4096)).cast("int").alias("edge"), F.round("distal_length", 6).alias("distal"))


def edge_taxa(spark, d):
    """The lowest taxon over all leaves below each edge; leaf k belongs to nation k % 25."""
    n = table(spark, d, "nation")
    nation = n.select(F.concat(F.lit("n"), "n_nationkey").alias("tax_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    region = n.select(F.concat(F.lit("r"), "n_regionkey").alias("tax_id"), F.lit("root").alias("parent_id")).distinct()
    taxa = nation.unionByName(region).unionByName(region.select(F.lit("root").alias("tax_id"), F.lit("root").alias("parent_id")).distinct())
    main = numbered(forest(spark, d))
    mapping = main.where("is_leaf").select("name", F.concat(F.lit("n"), F.col("name").cast("long") % 25).alias("tax_id")).join(nation.select("tax_id"), "tax_id", "left_semi")
    got = placement.edge_taxa(main, mapping, placement.taxonomy_closure(taxa))
    return main.select("tree_id", "edge_num", "node").join(got, "edge_num").select(*_id(), "node", "tax_id")


def _nations(spark, d):
    """Taxonomy (tax_id, parent_id, rank, tax_name): nations, regions and their root."""
    n = table(spark, d, "nation")
    nation = n.select(F.concat(F.lit("n"), "n_nationkey").alias("tax_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit("nation").alias("rank"))
    region = n.select(F.concat(F.lit("r"), "n_regionkey").alias("tax_id"), F.lit("root").alias("parent_id"), F.lit("region").alias("rank")).distinct()
    root = n.select(F.lit("root").alias("tax_id"), F.lit("root").alias("parent_id"), F.lit("root").alias("rank")).distinct()
    return nation.unionByName(region).unionByName(root).withColumn("tax_name", F.upper("tax_id"))


def classified_placements(spark, d):
    """Every leaf placed on its own edge and the one above; leaf k belongs to nation k % 25."""
    main = materialise(numbered(forest(spark, d)))
    up = main.select("tree_id", F.col("node_id").alias("parent_id"), F.col("edge_num").alias("up"))
    both = main.where("is_leaf and edge_num is not null").join(up, ["tree_id", "parent_id"]).where("up is not null")
    p = both.select(F.col("name").alias("fragment"), F.explode(F.array(F.struct("edge_num", (F.col("length") + 0.1).alias("lwr")), F.struct(F.col("up").alias("edge_num"), F.lit(0.5).cast("double").alias("lwr")))).alias("x")).select("fragment", "x.*", F.lit(1.0).alias("prior"))
    taxa = _nations(spark, d)
    mapping = main.where("is_leaf").select("name", F.concat(F.lit("n"), F.col("name").cast("long") % 25).alias("tax_id")).join(taxa.select("tax_id"), "tax_id", "left_semi")
    got = placement.classify(p, main, taxa, mapping, total=0.9, cutoff=0.05, least=0.5)
    return got.select(F.col("fragment").cast("long").alias("fragment"), "id", "name", "rank", "prob")


def insertion_trees(spark, d):
    """Fragments put into the trees: one on each leaf's edge, others with several on the edge above; leaves by distance."""
    main = materialise(numbered(forest(spark, d)))
    up = main.select("tree_id", F.col("node_id").alias("parent_id"), F.col("edge_num").alias("up"))
    leaf = main.where("is_leaf and edge_num is not null").join(up, ["tree_id", "parent_id"]).where("up is not null").withColumn("k", F.col("name").cast("long"))
    own = leaf.where("k % 3 = 0").select("k", "edge_num", (F.col("length") / 2).alias("distal_length"))
    high = leaf.where("k % 3 = 1").select("k", F.col("up").alias("edge_num"), (F.col("k") % 7 * 0.01).alias("distal_length"))
    p = own.unionByName(high).select(F.format_string("q%d", "k").alias("fragment"), "edge_num", "distal_length", F.lit(0.25).alias("pendant_length"), F.lit(1.0).alias("lwr"))
    got = trees.from_parents(placement.insertion_tree(main, p))
    return trees.root_distance(materialise(got)).where("is_leaf").select(*_id(), "name", F.round("dist", 6).alias("dist"))


def transferred_labels(spark, d):
    """Names of the inner nodes of the trees by id, given to the nodes of the trees by first component with the same split."""
    old, new = forests(spark, d, "vec_id", "x0")
    old = old.withColumn("name", F.when(F.col("is_leaf"), F.col("name")).otherwise(F.concat(F.lit("N"), "node")))
    got = splits.transfer_labels(old, new)
    return got.where("not is_leaf and name is not null").select(*_id(), "node", "name")


def missed_labels(spark, d):
    old, new = forests(spark, d, "vec_id", "x0")
    old = old.withColumn("name", F.when(F.col("is_leaf"), F.col("name")).otherwise(F.concat(F.lit("N"), "node")))
    return splits.missed_labels(old, new).select(*_id(), "name")


def shared_splits(spark, d):
    return splits.shared_splits(*forests(spark, d, "vec_id", "x0")).select(*_id(), "shared", "only_a", "only_b")


def edge_support(spark, d):
    """Support of each block's inner edges among the block's three trees: by id, by first and by second component."""
    ref, one, two_ = [t.withColumn("family", F.col("tree_id")).withColumn("tree_id", F.lit(k)) for k, t in enumerate(forests(spark, d, "vec_id", "x0", "x1"))]
    got = splits.edge_support(ref, ref.unionByName(one).unionByName(two_))
    return got.join(ref.select("family", "node_id", "node"), ["family", "node_id"]).select(F.col("family.label").alias("label"), F.col("family.block").alias("block"), "node", F.round("support", 6).alias("support"))


def incompatible_splits(spark, d):
    return splits.incompatible_clusters(*forests(spark, d, "vec_id", "x0")).select(*_id(), "incompatible")


def same_leaf_sets(spark, d):
    return splits.same_leaves(forest(spark, d), forest(spark, d, "x0")).select(*_id(), "same")


def decomposed_trees(spark, d):
    """Subsets of at most 12 leaves, numbered in depth-first order."""
    got = decompose.numbered_subsets(decompose.decompose(forest(spark, d), 12, least=2))
    return got.select(*_id(), F.col("name").cast("long").alias("name"), "subset", "ordinal")


def decomposed_by_diameter(spark, d):
    """Subsets of at most 40 leaves whose longest path is at most 1.2, cut at the middle of that path."""
    got = decompose.decompose(forest(spark, d), 40, "midpoint", least=2, widest=1.2)
    return got.select(*_id(), F.col("name").cast("long").alias("name"), "subset")


def decomposed_by_distance(spark, d):
    """Subsets of at most 60 leaves whose rows in the alignment differ by at most 0.70 on average."""
    from cladeframe.operators import distance

    from .fixtures import KEYS, dense

    far = distance.pairs(dense(spark, d), KEYS).select(F.struct(*KEYS).alias("tree_id"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "d")
    got = decompose.decompose(forest(spark, d), 60, least=2, farthest=0.70, distances=materialise(far))
    return got.select(*_id(), F.col("name").cast("long").alias("name"), "subset")


def placement_hierarchy(spark, d):
    got = decompose.hierarchy(forest(spark, d), 24, 8)
    return got.select(*_id(), F.col("name").cast("long").alias("name"), "p_id", "a_id")


def midpoint_edges(spark, d):
    n = forest(spark, d)
    return _named(n, trees.midpoint_edge(n), F.round("diameter", 6).alias("diameter"))


def rerooted_trees(spark, d):
    """Rooted at the middle edge: distances between leaves stay, so the diameter does."""
    n = forest(spark, d)
    r = trees.from_parents(trees.reroot(n, trees.midpoint_edge(n).select("tree_id", "node_id")))
    return trees.diameter(materialise(r)).select(*_id(), F.round("diameter", 5).alias("diameter"))


def all_binary_trees(spark, d):
    """Every binary tree over the nations of a region, as its sorted clades of more than one nation."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("set_id"), F.format_string("%02d", "n_nationkey").alias("name"))
    names = n.groupBy("set_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    t = resolutions.all_trees(n).join(names, "set_id")
    named = lambda c: F.array_join(F.filter(F.col("names"), lambda x, i: F.getbit(c, i) == 1), ",")
    clades = F.array_sort(F.transform(F.filter("clades", lambda c: F.bit_count(c) > 1), named))
    return t.select("set_id", F.array_join(clades, ";").alias("clades"))


def _quartered(spark, d):
    """The trees by id without the inner nodes of odd depth: up to four children a node."""
    n = materialise(trees.root_distance(forest(spark, d)))
    return materialise(trees.renumber(n.where("is_leaf or depth % 2 = 0").select("tree_id", "node", "name", "length", "leaf_lo", "leaf_hi")))


def child_unions(spark, d):
    """Unions of two or more, but not all, children of nodes with more than two; their leaves and the places of the children."""
    n = _quartered(spark, d)
    return resolutions.unions(n).join(n.select("tree_id", "node_id", "node"), ["tree_id", "node_id"]).select(*_id(), "node", "children", F.col("leaves").cast("long").alias("leaves"))


def resolved_pieces(spark, d):
    """How often each union of children is a node of a resolution of the tree's first node with more than two children."""
    n = _quartered(spark, d)
    p = resolutions.polytomies(n).groupBy("tree_id").agg(F.min("node_id").alias("node_id"))
    own = n.join(p.select("tree_id", F.col("node_id").alias("_p")), "tree_id").where("node_id = _p or parent_id = _p")
    own = own.withColumn("parent_id", F.when(F.col("node_id") != F.col("_p"), F.col("parent_id")))
    got = resolutions.all_resolutions(own)
    return got.join(n.select("tree_id", "node_id", "node"), ["tree_id", "node_id"]).groupBy(*_id(), "node", "children").agg(F.count("*").alias("resolutions"))


def all_rootings(spark, d):
    """For every edge as the root: leaves on both sides, and how far the farthest of each is from the edge's middle."""
    n = forest(spark, d)
    got = resolutions.directed(n).join(n.select("tree_id", "node_id", "node"), ["tree_id", "node_id"])
    return got.select(*_id(), "node", "below_leaves", "above_leaves", F.round("below_far", 6).alias("below_far"), F.round("above_far", 6).alias("above_far"))


def rerooted_distances(spark, d):
    """Every leaf's distance from the new root in the middle of the middle edge, and whether it lies below that edge."""
    n = forest(spark, d)
    edge = materialise(trees.midpoint_edge(n).select("tree_id", "node_id"))
    r = materialise(trees.root_distance(trees.from_parents(trees.reroot(n, edge))))
    first = r.join(r.where("node = -1").select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"]).join(edge.select("tree_id", F.col("node_id").alias("node")), ["tree_id", "node"]).select("tree_id", F.col("leaf_lo").alias("lo"), F.col("leaf_hi").alias("hi"))
    got = r.where("is_leaf").join(first, "tree_id")
    return got.select(*_id(), F.col("name").cast("long").alias("name"), F.col("leaf_lo").between(F.col("lo"), F.col("hi")).alias("below"), F.round("dist", 6).alias("dist"))


def placement_normalise(spark, d):
    p = placement.normalised(placement.weighted(placements(spark, d)))
    return p.select("fragment", "edge_num", F.round("p", 6).alias("p"))


def placement_threshold(spark, d):
    p = placement.normalised(placement.weighted(placements(spark, d)))
    kept = placement.threshold(p, 0.6, 0.05)
    return placement.distribution(kept).select("fragment", "edge_num", F.round("p", 6).alias("p"), F.round("share", 6).alias("share"))


def best_placements(spark, d):
    return placement.best(placements(spark, d).select("fragment", "edge_num", "lwr")).select("fragment", "edge_num", "lwr")


def distal_clip(spark, d):
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_num"), (10 + F.col("s_nationkey")).cast("double").alias("length"))
    got = placement.clip(placements(spark, d), edges)
    return got.groupBy("fragment").agg(F.round(F.sum("distal_length"), 4).alias("distal"), F.count("*").alias("n"))


def _taxa(spark, d):
    t = lambda rows, i, p, r: rows.select(i.alias("tax_id"), p.alias("parent_id"), F.lit(r).alias("rank"))
    c = lambda pre, col: F.concat(F.lit(pre), F.col(col).cast("string"))
    none = F.lit(None).cast("string")
    root = table(spark, d, "region").limit(1).select(F.lit("root").alias("tax_id"), none.alias("parent_id"), F.lit("root").alias("rank"))
    return (
        root.unionByName(t(table(spark, d, "region"), c("r", "r_regionkey"), F.lit("root"), "region")).unionByName(t(table(spark, d, "nation"), c("n", "n_nationkey"), c("r", "n_regionkey"), "nation"))
        .unionByName(t(table(spark, d, "supplier"), c("s", "s_suppkey"), c("n", "s_nationkey"), "supplier"))
    )


def taxonomic_rollup(spark, d):
    p = placement.normalised(placement.weighted(placements(spark, d)))
    shares = p.select("fragment", F.concat(F.lit("s"), F.col("edge_num").cast("string")).alias("tax_id"), "p")
    got = placement.rollup(shares, placement.taxonomy_closure(_taxa(spark, d)).select("tax_id", "anc"), None)
    return got.select("fragment", "tax_id", F.round("p", 6).alias("p"))


def classified_fragments(spark, d):
    p = placement.normalised(placement.weighted(placements(spark, d)))
    shares = p.select("fragment", F.concat(F.lit("s"), F.col("edge_num").cast("string")).alias("tax_id"), F.round("p", 6).alias("p"))
    got = placement.rollup(shares, placement.taxonomy_closure(_taxa(spark, d)).select("tax_id", "anc"), None).where(F.round("p", 5) >= 0.7)
    return placement.classification_lines(got, _taxa(spark, d).withColumn("tax_name", F.upper("tax_id"))).select("fragment", "id", "name", "rank")


def jplace_documents(spark, d):
    """Documents written as JSON text and read back: one per supplier, with its placements."""
    docs = documents.to_jplace(placements(spark, d).select(F.col("edge_num").cast("string").alias("doc_id"), F.col("fragment").cast("string").alias("fragment"), F.col("fragment").cast("int").alias("edge_num"), F.lit(0.0).alias("likelihood"), "lwr", "distal_length", F.lit(0.0).alias("pendant_length")))
    back = documents.from_jplace(docs.select("doc_id", "json"))
    return back.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("fragment").alias("fragments"), F.round(F.sum("lwr"), 2).alias("lwr"), F.round(F.sum("distal_length"), 2).alias("distal"))


def jplace_rows(spark, d):
    """Documents with several records of one fragment each, written as JSON and read back: all rows."""
    p = placements(spark, d).select(F.col("edge_num").cast("string").alias("doc_id"), F.format_string("f%d", F.col("fragment") % 50).alias("fragment"), F.col("fragment").alias("record"), F.col("fragment").cast("int").alias("edge_num"), F.lit(-1.5).alias("likelihood"), "lwr", "distal_length", F.lit(0.25).alias("pendant_length"))
    back = documents.from_jplace(documents.to_jplace(p))
    return back.select("doc_id", "fragment", "edge_num", "likelihood", "lwr", "distal_length", "pendant_length", "copies")


def jplace_faults(spark, d):
    """Documents of which some are cut off or lack their fields, and what is said of them."""
    o = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.col("s_suppkey").alias("k"))
    body = F.when(F.col("k") % 5 == 0, '{"tree": "t", "placements": [{"p": [[1').when(F.col("k") % 7 == 0, '{"tree": "t", "placements": []}').when(F.col("k") % 11 == 0, F.lit(None).cast("string")).otherwise('{"tree": "t", "fields": ["edge_num"], "placements": []}')
    return documents.faults(o.select("doc_id", body.alias("json")))


def event_properties(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def tree_from_clusters(spark, d):
    """The inner clades of each tree as bare sets of leaves, put together again."""
    n = forest(spark, d)
    inner = n.where("not is_leaf").select("tree_id", F.col("node_id").alias("anc"), "node")
    leaf = n.where("is_leaf").select("tree_id", "node_id", "name")
    sets = leaf.join(trees.ancestors(n, strict=True).drop("via"), ["tree_id", "node_id"]).join(inner, ["tree_id", "anc"])
    got = splits.tree_of_clusters(sets.select(F.col("tree_id").alias("set_id"), F.col("node").alias("cluster_id"), "name"))
    return got.select(F.col("set_id.label").alias("label"), F.col("set_id.block").alias("block"), F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent"), "n")


def shared_clades(spark, d):
    n, other = forests(spark, d, "vec_id", "x0")
    return _named(n, splits.shared_clades(n, other), "leaves")


def collapsed_trees(spark, d):
    n = forest(spark, d)
    small = trees.leaf_counts(n).where("leaves between 2 and 3")
    top = small.join(small.select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"], "left_anti")
    out, _ = splits.collapse(n, top)
    return out.where("is_leaf").select(*_id(), "name", F.col("leaf_lo").alias("rank"))


def fasta_round_trip(spark, d):
    """Alignments rendered as FASTA text, cut at record starts and scanned again."""
    from cladeframe.operators import sites
    from cladeframe.sources import sinks, text

    from .fixtures import KEYS, dense

    whole = sinks.rendered(sites.to_rows(dense(spark, d), KEYS), KEYS)
    raw = whole.select(F.posexplode(F.split("value", "\n>")).alias("file_pos", "r"))
    return text.fasta_records(raw).select(F.col("name").cast("long").alias("name"), "seq")


def stockholm_scan(spark, d):
    """Alignments written as Stockholm text in two blocks, every fifth column an insertion, and scanned again."""
    from cladeframe.operators import sites
    from cladeframe.sources import text

    from .fixtures import KEYS, dense

    lower = dense(spark, d).withColumn("ch", F.when(F.col("pos") % 5 == 4, F.when(F.col("ch") == "-", ".").otherwise(F.lower("ch"))).otherwise(F.col("ch")))
    rows = sites.to_rows(lower, KEYS)
    # Lines are rows; no file is ever one row.
    line = lambda a, n: F.concat(F.col("name").cast("string"), F.lit(" "), F.substr("seq", F.lit(a), F.lit(n)))
    body = rows.select(F.concat_ws(":", *KEYS).alias("file"), F.inline(F.array(F.struct(F.lit(2).alias("part"), "name", line(1, 32).alias("line")), F.struct(F.lit(4).alias("part"), "name", line(33, 64).alias("line")))))
    other = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("name"), F.lit(t).alias("line")) for p, t in ((0, "# STOCKHOLM 1.0"), (1, ""), (3, ""), (5, "//"), (6, "ignored text"))])
    around = rows.select(F.concat_ws(":", *KEYS).alias("file")).distinct().select("file", F.inline(other))
    seqs, cols = text.stockholm(ordinal(body.unionByName(around), ["file"], ["part", "name"], "ln").select("file", "ln", "line"))
    kept = cols.where("label >= 0").groupBy("file").agg(F.count("*").alias("original"))
    return seqs.join(kept, "file").select("file", F.col("name").cast("long").alias("name"), "seq", "original")


def search_report_scan(spark, d):
    """Hits written as lines of search reports, one report per event type, and scanned again. No report is ever one row."""
    from cladeframe.sources import text

    from .fixtures import hits

    h = hits(spark, d).where("bitscore is not null and evalue is not null")
    line = F.concat_ws("  ", F.format_string("%.3f", "evalue"), F.format_string("%.2f", "bitscore"), F.lit("0.1 1.0 2.0 0.1 1.0 1"), F.col("fragment").cast("string"))
    body = h.select(F.col("subset").alias("file"), "fragment", line.alias("line")).orderBy("file", "fragment")
    body = body.select("file", (F.monotonically_increasing_id() + 4).alias("ln"), "line")
    head = ["# report", "", "    E-value  score  bias  E-value  score  bias  exp  N  Sequence", "    ------- ------ ----- ------- ------ ----- --- -- --------"]
    end = 1 << 62
    around = F.array(*[F.struct(F.lit(n).cast("long").alias("ln"), F.lit(t).alias("line")) for n, t in [*enumerate(head), (end, ""), (end + 1, "other 1 2 3 4 5 6 7 8 9")]])
    around = h.select(F.col("subset").alias("file")).distinct().select("file", F.inline(around))
    got = text.search_hits(body.unionByName(around))
    return got.select(F.col("file").alias("subset"), F.col("name").cast("long").alias("fragment"), "evalue", "bitscore")


def viterbi_align(spark, d):
    """Degapped rows aligned to their own block's profile: the share of residues that come back to their site."""
    from cladeframe.operators import profile, sites

    from .fixtures import KEYS, dense

    s = dense(spark, d).withColumn("key", F.concat_ws(":", *KEYS))
    rows = sites.to_rows(s.where("ch <> '-'"), ["key"])
    got = profile.align(rows, profile.build(s, ["key"]), "key")
    return got.groupBy("key", "name").agg(F.max("score").alias("score"), F.count("*").alias("residues"), F.sum((F.col("site") >= 0).cast("long")).alias("on_sites"))


def node_shapes(spark, d):
    return trees.shape(forest(spark, d)).select(*_id(), "node", "children", "degree", "siblings", "depth", "height")


def leaf_positions(spark, d):
    return trees.leaf_positions(forest(spark, d)).select(*_id(), "name", "position")


def genealogical_index(spark, d):
    """Index of leaves in three groups by id, in every tree."""
    n = forest(spark, d)
    groups = n.where("is_leaf").select("name", (F.col("name").cast("long") % 3).alias("group")).distinct()
    return trees.genealogical_index(n, groups).select(*_id(), "group", F.round("gsi", 6).alias("gsi"))


NAMES = """node_shapes leaf_positions genealogical_index tree_from_clusters shared_clades collapsed_trees fasta_round_trip stockholm_scan search_report_scan viterbi_align edge_leaf_counts root_distances centroid_edge longest_edge clade_edge product_edge bisected_leaves adjacent_edges leaf_distance tree_diameter nearest_taxa lca_pairs lca_of_sets
merged_placements edge_taxa classified_placements insertion_trees transferred_labels missed_labels long_branches pruned_trees binary_trees scaled_lengths labelled_nodes newick_round_trip split_relabel shared_splits edge_support incompatible_splits same_leaf_sets decomposed_trees
decomposed_by_diameter decomposed_by_distance placement_hierarchy midpoint_edges rerooted_trees rerooted_distances all_rootings all_binary_trees child_unions resolved_pieces placement_normalise placement_threshold best_placements distal_clip taxonomic_rollup classified_fragments
jplace_documents jplace_rows jplace_faults event_properties""".split()
QUERIES = {n: globals()[n] for n in NAMES}

T, TL, TD = sql_tree(), f"{sql_tree()}, {SQL_LEAVES}", f"{sql_tree()}, {SQL_DIST}"
PAIRS = f"""{TD}, lf AS (SELECT n.label, n.block, n.node, n.name::BIGINT AS name, d FROM nodes n JOIN dist USING (label, block, node) WHERE n.name IS NOT NULL),
mt AS (SELECT a.label, a.block, a.node AS x, b.node AS y, max(u.anc) AS l FROM lf a JOIN lf b ON a.label = b.label AND a.block = b.block AND a.name < b.name
  JOIN up u ON u.label = a.label AND u.block = a.block AND u.node = a.node JOIN up v ON v.label = b.label AND v.block = b.block AND v.node = b.node AND v.anc = u.anc GROUP BY ALL),
ld AS (SELECT mt.label, mt.block, a.name AS a, b.name AS b, a.d + b.d - 2 * c.d AS d FROM mt JOIN lf a ON a.label = mt.label AND a.block = mt.block AND a.node = mt.x
  JOIN lf b ON b.label = mt.label AND b.block = mt.block AND b.node = mt.y JOIN dist c ON c.label = mt.label AND c.block = mt.block AND c.node = mt.l)"""


def two(order: str = "x0") -> str:
    """CTEs with sorted leaf sets of both trees: a and b (label, block, node, set, canonical)."""
    side = lambda p: (
        f"{p}cl AS (SELECT u.label, u.block, u.anc AS node, list_sort(list(n.name)) AS s FROM {p}up u JOIN {p}nodes n USING (label, block, node) WHERE n.name IS NOT NULL GROUP BY ALL), "
        f"{p}al AS (SELECT label, block, s AS every FROM {p}cl WHERE node = 1), "
        f"{p}sp AS (SELECT c.label, c.block, node, s, every, list_filter(every, lambda x: NOT list_contains(s, x)) AS r FROM {p}cl c JOIN {p}al USING (label, block)), "
        f"{p}k AS (SELECT *, least(array_to_string(s, '()'), array_to_string(r, '()')) AS canon FROM {p}sp)"
    )
    return f"{sql_tree()}, {sql_tree('b', order)}, {side('')}, {side('b')}"


TRIO = lambda: f"{two()}, {sql_tree('c', 'x1')}, ccl AS (SELECT u.label, u.block, u.anc AS node, list_sort(list(n.name)) AS s FROM cup u JOIN cnodes n USING (label, block, node) WHERE n.name IS NOT NULL GROUP BY ALL), ck AS (SELECT c.label, c.block, c.node, least(array_to_string(c.s, '()'), array_to_string(list_filter(every, lambda x: NOT list_contains(c.s, x)), '()')) AS canon FROM ccl c JOIN al USING (label, block))"
W = "w AS (SELECT l_orderkey AS fragment, l_suppkey AS edge_num, sum(l_extendedprice * (1 - l_discount)) AS w FROM lineitem GROUP BY ALL), p AS (SELECT fragment, edge_num, w / sum(w) OVER (PARTITION BY fragment) AS p FROM w)"

# Children (ord from 0, of k) of the nodes that stay when inner nodes of odd depth go.
QUARTERS = "keep_ AS (SELECT * FROM lv WHERE name IS NOT NULL OR length(key) % 2 = 1), pa AS (SELECT k.label, k.block, k.node AS child, k.key, k.leaves, max(u.anc) AS node FROM keep_ k JOIN up u ON u.label = k.label AND u.block = k.block AND u.node = k.node AND u.anc < k.node JOIN keep_ p ON p.label = u.label AND p.block = u.block AND p.node = u.anc GROUP BY ALL), kid AS (SELECT *, (row_number() OVER (PARTITION BY label, block, node ORDER BY key) - 1)::INT AS ord, (count(*) OVER (PARTITION BY label, block, node))::INT AS k FROM pa)"
# The nations and regions of the leaves below every node.
TAXA = "h AS (SELECT u.label, u.block, u.anc AS node, count(DISTINCT n_nationkey) AS n1, count(DISTINCT n_regionkey) AS n2, min(n_nationkey) AS a, min(n_regionkey) AS r_ FROM up u JOIN nodes n USING (label, block, node) JOIN nation ON n_nationkey = n.name::BIGINT % 25 WHERE n.name IS NOT NULL GROUP BY ALL)"
# Leaf sets of pieces, round by round. Each round keeps the leaves of pieces that are too large (big: label, block, s, n) and
# gives them their side of the piece's edge; an edge is the lowest node with its leaves of the piece.
ROUND = """
sz AS (SELECT label, block, s, count(*) AS n FROM piece GROUP BY ALL), {big},
held AS (SELECT p.label, p.block, p.s, up.anc, any_value(n) AS n, count(*) AS m, min(k.key) AS lo, max(k.key) AS hi FROM piece p JOIN big USING (label, block, s) JOIN up USING (label, block, node) JOIN nodes k USING (label, block, node) GROUP BY ALL),
edge AS (SELECT label, block, s, max(anc) AS c, any_value(n) AS n, any_value(m) AS m FROM held GROUP BY label, block, s, lo, hi),
best AS (SELECT edge.label, edge.block, edge.s, arg_min(c, (abs(n / 2.0 - m), e.key)) AS c FROM edge JOIN nodes e ON e.label = edge.label AND e.block = edge.block AND e.node = edge.c WHERE m >= {least} AND n - m >= {least} GROUP BY ALL), {cut}
SELECT p.label, p.block, p.node, p.s || CASE WHEN u.anc IS NULL THEN '1' ELSE '0' END AS s FROM piece p JOIN cut_ USING (label, block, s) LEFT JOIN up u ON u.label = p.label AND u.block = p.block AND u.node = p.node AND u.anc = cut_.c"""


def pieces(big: str, least: int, cut: str = "cut_ AS (SELECT * FROM best)", start: str = "SELECT label, block, node, '' AS s FROM nodes WHERE name IS NOT NULL", name: str = "piece") -> str:
    """Recursive CTE `name` (label, block, node, s): the leaves of every piece that is cut or left, with the path of its cuts."""
    one = ROUND.format(big=big, least=least, cut=cut)
    return f"{name} AS ({start} UNION ALL (WITH {one.replace('piece', name)}))"


def last(name: str = "piece", out: str = "last") -> str:
    """CTE of every leaf's last piece (label, block, name, node, subset)."""
    return f"{out} AS (SELECT label, block, n.name::BIGINT AS name, node, arg_max(s, length(s)) AS subset FROM {name} JOIN nodes n USING (label, block, node) GROUP BY ALL)"


LONG = f"{PAIRS}, ln AS (SELECT mt.label, mt.block, x, y, a.d + b.d - 2 * c.d AS d, CASE WHEN a.d >= b.d THEN x ELSE y END AS anchor, greatest(a.d, b.d) AS deep FROM mt JOIN lf a ON a.label = mt.label AND a.block = mt.block AND a.node = mt.x JOIN lf b ON b.label = mt.label AND b.block = mt.block AND b.node = mt.y JOIN dist c ON c.label = mt.label AND c.block = mt.block AND c.node = mt.l)"
# The lowest node above the deeper end whose parent is at least half of the path away.
MIDDLE = "SELECT f.label, f.block, {s} max(u.anc) AS c, any_value(f.d) AS d FROM far f JOIN up u ON u.label = f.label AND u.block = f.block AND u.node = f.anchor JOIN nodes k ON k.label = f.label AND k.block = f.block AND k.node = u.anc JOIN dist q ON q.label = f.label AND q.block = f.block AND q.node = k.parent WHERE f.deep - q.d >= f.d / 2 GROUP BY ALL"
WIDE_BIG = """far AS (SELECT p.label, p.block, p.s, max(ln.d) AS d, arg_max(anchor, ln.d) AS anchor, arg_max(deep, ln.d) AS deep FROM piece p JOIN ln ON ln.label = p.label AND ln.block = p.block AND ln.x = p.node JOIN piece o ON o.label = p.label AND o.block = p.block AND o.s = p.s AND o.node = ln.y GROUP BY ALL),
big AS (SELECT sz.* FROM sz JOIN far USING (label, block, s) WHERE n > 40 OR d > 1.2)"""
WIDE_CUT = f"""mid AS ({MIDDLE.format(s="f.s,")}), good AS (SELECT m.label, m.block, m.s, m.c FROM mid m JOIN held h ON h.label = m.label AND h.block = m.block AND h.s = m.s AND h.anc = m.c WHERE h.m >= 2 AND h.n - h.m >= 2),
cut_ AS (SELECT label, block, s, coalesce(good.c, best.c) AS c FROM good FULL JOIN best USING (label, block, s))"""
FAR_BIG = "mean AS (SELECT p.label, p.block, p.s, avg(d) AS d FROM piece p JOIN pn ON pn.label = p.label AND pn.block = p.block AND pn.x = p.node JOIN piece o ON o.label = p.label AND o.block = p.block AND o.s = p.s AND o.node = pn.y GROUP BY ALL), big AS (SELECT sz.* FROM sz JOIN mean USING (label, block, s) WHERE n > 60 OR d > 0.70)"
ROOTED = f"{LONG}, far AS (SELECT label, block, max(d) AS d, arg_max(anchor, d) AS anchor, arg_max(deep, d) AS deep FROM ln GROUP BY ALL), mid AS ({MIDDLE.format(s='')})"


def differing_pairs() -> str:
    """CTE pn (label, block, x, y, d): p-distances of the leaves of a tree, by node."""
    from .q_sequences import NOGAP
    from .q_sequences import PAIRS as ROWS

    return f"{SQL_DENSE}, {ROWS.format(where=NOGAP)}, {T}, pn AS (SELECT pr.label, pr.block, x.node AS x, y.node AS y, d FROM pr JOIN nodes x ON x.label = pr.label AND x.block = pr.block AND x.name = pr.a::VARCHAR JOIN nodes y ON y.label = pr.label AND y.block = pr.block AND y.name = pr.b::VARCHAR)"


ORACLES = {
    "decomposed_trees": f"WITH RECURSIVE {T}, {pieces('big AS (SELECT * FROM sz WHERE n > 12)', 2)}, {last()}, o AS (SELECT label, block, subset, row_number() OVER (PARTITION BY label, block ORDER BY subset) - 1 AS ordinal FROM (SELECT DISTINCT label, block, subset FROM last)) SELECT label, block, name, subset, ordinal FROM last JOIN o USING (label, block, subset)",
    "decomposed_by_diameter": f"WITH RECURSIVE {LONG}, {pieces(WIDE_BIG, 2, WIDE_CUT)}, {last()} SELECT label, block, name, subset FROM last",
    "decomposed_by_distance": f"WITH RECURSIVE {differing_pairs()}, {pieces(FAR_BIG, 2)}, {last()} SELECT label, block, name, subset FROM last",
    "placement_hierarchy": f"WITH RECURSIVE {T}, {pieces('big AS (SELECT * FROM sz WHERE n > 24)', 6)}, {last()}, {pieces('big AS (SELECT * FROM sz WHERE n > 8)', 1, start='SELECT label, block, node, subset || chr(124) AS s FROM last', name='part')}, {last('part', 'ends')} SELECT label, block, name, split_part(subset, '|', 1) AS p_id, split_part(subset, '|', 2) AS a_id FROM ends",
    "midpoint_edges": f"WITH {ROOTED} SELECT label, block, c AS node, round(d, 6) AS diameter FROM mid",
    "all_rootings": f"WITH {LONG}, {SQL_LEAVES}, lk AS (SELECT n.label, n.block, n.node, n.length, l.node AS leaf, l.d AS ld, max(u.anc) AS meet FROM nodes n JOIN lf l ON l.label = n.label AND l.block = n.block JOIN up u ON u.label = n.label AND u.block = n.block AND u.node = n.node JOIN up v ON v.label = n.label AND v.block = n.block AND v.node = l.node AND v.anc = u.anc WHERE n.node > 1 GROUP BY ALL), ds AS (SELECT k.label, k.block, k.node, k.length, meet = k.node AS inside, ld + a.d - 2 * b.d AS d FROM lk k JOIN dist a ON a.label = k.label AND a.block = k.block AND a.node = k.node JOIN dist b ON b.label = k.label AND b.block = k.block AND b.node = k.meet) SELECT ds.label, ds.block, ds.node, any_value(leaves) AS below_leaves, any_value(total - leaves) AS above_leaves, round(max(CASE WHEN inside THEN d END) + any_value(ds.length) / 2, 6) AS below_far, round(max(CASE WHEN NOT inside THEN d END) - any_value(ds.length) / 2, 6) AS above_far FROM ds JOIN lv USING (label, block, node) GROUP BY ALL",
    "all_binary_trees": "WITH RECURSIVE nm AS (SELECT n_regionkey AS set_id, list(lpad(n_nationkey::VARCHAR, 2, '0') ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL), t AS (SELECT set_id, names, 1 AS i, [[names[1]]] AS clades FROM nm UNION ALL SELECT set_id, names, i + 1, list_concat(list_transform(clades, lambda c: CASE WHEN len(list_intersect(c, e)) = len(e) AND len(c) > len(e) THEN list_append(c, names[i + 1]) ELSE c END), [list_append(e, names[i + 1]), [names[i + 1]]]) FROM (SELECT *, unnest(clades) AS e FROM t WHERE i < len(names))) SELECT set_id, array_to_string(list_sort(list_transform(list_filter(clades, lambda c: len(c) > 1), lambda c: array_to_string(list_sort(c), ','))), ';') AS clades FROM t WHERE i = len(names)",
    "child_unions": f"WITH {TL}, {QUARTERS}, ms AS (SELECT unnest(range(3, 15)) AS children), pick AS (SELECT q.label, q.block, q.node, k, m.children, sum(leaves) AS leaves, count(*) AS c FROM kid q JOIN ms m ON (m.children >> ord) & 1 = 1 AND m.children < (1 << k) WHERE k > 2 GROUP BY ALL) SELECT label, block, node, children, leaves FROM pick WHERE c > 1 AND c < k",
    "resolved_pieces": f"WITH {TL}, {QUARTERS}, top AS (SELECT label, block, k, arg_min(q.node, n.key) AS node FROM kid q JOIN nodes n USING (label, block, node) WHERE k > 2 GROUP BY label, block, k), one AS (SELECT t.* FROM top t JOIN nodes n USING (label, block, node) QUALIFY row_number() OVER (PARTITION BY t.label, t.block ORDER BY n.key) = 1), ms AS (SELECT unnest(range(3, 15)) AS children) SELECT label, block, node, children, CASE WHEN k = 3 THEN 1 ELSE 3 END AS resolutions FROM one JOIN ms ON children < (1 << k) AND bit_count(children) BETWEEN 2 AND k - 1",
    "rerooted_distances": f"WITH {ROOTED}, m AS (SELECT m.label, m.block, m.c, q.d AS dc, k.length AS len FROM mid m JOIN dist q ON q.label = m.label AND q.block = m.block AND q.node = m.c JOIN nodes k ON k.label = m.label AND k.block = m.block AND k.node = m.c), lc AS (SELECT l.label, l.block, l.name, l.d, m.c, m.dc, m.len, max(u.anc) AS meet FROM lf l JOIN m ON m.label = l.label AND m.block = l.block JOIN up u ON u.label = l.label AND u.block = l.block AND u.node = l.node JOIN up v ON v.label = l.label AND v.block = l.block AND v.node = m.c AND v.anc = u.anc GROUP BY ALL) SELECT lc.label, lc.block, name, meet = c AS below, round(CASE WHEN meet = c THEN lc.d - dc + len / 2 ELSE lc.d + dc - 2 * q.d - len / 2 END, 6) AS dist FROM lc JOIN dist q ON q.label = lc.label AND q.block = lc.block AND q.node = lc.meet",
    "node_shapes": f"WITH {TL}, ch AS (SELECT label, block, parent AS node, count(*) AS c FROM nodes WHERE parent IS NOT NULL GROUP BY ALL), dp AS (SELECT u.label, u.block, u.anc AS node, max(length(n.key)) AS deep FROM up u JOIN nodes n USING (label, block, node) WHERE n.name IS NOT NULL GROUP BY ALL) SELECT n.label, n.block, n.node, coalesce(c, 0) AS children, coalesce(c, 0) + CASE WHEN n.parent IS NULL THEN 0 ELSE 1 END AS degree, CASE WHEN n.parent IS NULL THEN 0 ELSE 1 END AS siblings, length(n.key) - 1 AS depth, deep - length(n.key) AS height FROM nodes n LEFT JOIN ch USING (label, block, node) JOIN dp USING (label, block, node)",
    "leaf_positions": f"WITH {T} SELECT label, block, name, (row_number() OVER (PARTITION BY label, block ORDER BY name) - 1)::INT AS position FROM nodes WHERE name IS NOT NULL",
    "genealogical_index": f"WITH {T}, ex AS (SELECT label, block, parent AS node, count(*) + max(CASE WHEN parent > 1 THEN 1 ELSE 0 END) - 2 AS extra FROM nodes WHERE parent IS NOT NULL GROUP BY ALL), al AS (SELECT label, block, sum(extra) AS all_extra FROM ex GROUP BY ALL), g AS (SELECT label, block, node, name::BIGINT % 3 AS grp FROM nodes WHERE name IS NOT NULL), held AS (SELECT label, block, grp, anc, count(*) AS m FROM g JOIN up USING (label, block, node) GROUP BY ALL), sz AS (SELECT label, block, grp, count(*) AS n FROM g GROUP BY ALL), top AS (SELECT label, block, grp, max(anc) AS t FROM held JOIN sz USING (label, block, grp) WHERE m = n GROUP BY ALL), us AS (SELECT h.label, h.block, h.grp, sum(extra) AS extra FROM held h JOIN top USING (label, block, grp) JOIN ex ON ex.label = h.label AND ex.block = h.block AND ex.node = h.anc JOIN up u ON u.label = h.label AND u.block = h.block AND u.node = h.anc AND u.anc = t GROUP BY ALL) SELECT label, block, grp AS \"group\", round(CASE WHEN n < 2 OR extra IS NULL THEN -1.0 WHEN (n - 1) / all_extra = 1 THEN 1.0 ELSE ((n - 1) / extra - (n - 1) / all_extra) / (1 - (n - 1) / all_extra) END, 6) AS gsi FROM sz LEFT JOIN us USING (label, block, grp) LEFT JOIN al USING (label, block)",
    "tree_from_clusters": f"WITH {TL} SELECT label, block, node, parent, leaves AS n FROM lv WHERE name IS NULL",
    "shared_clades": f"WITH {two()}, bad AS (SELECT DISTINCT u.label, u.block, u.anc AS node FROM up u JOIN k USING (label, block, node) WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.label = k.label AND bk.block = k.block AND bk.s = k.s)), fine AS (SELECT k.label, k.block, k.node, len(s) AS leaves FROM k LEFT JOIN bad USING (label, block, node) WHERE bad.node IS NULL) SELECT f.label, f.block, f.node, f.leaves FROM fine f LEFT JOIN fine g ON g.label = f.label AND g.block = f.block AND g.node = f.node // 2 AND f.node > 1 WHERE g.node IS NULL AND f.leaves > 1",
    "collapsed_trees": f"WITH {TL}, small AS (SELECT label, block, node, key FROM lv WHERE leaves BETWEEN 2 AND 3), top AS (SELECT s.* FROM small s LEFT JOIN small t ON t.label = s.label AND t.block = s.block AND t.node = s.node // 2 WHERE t.node IS NULL), ins AS (SELECT t.label, t.block, t.node, t.key, n.name FROM top t JOIN up u ON u.label = t.label AND u.block = t.block AND u.anc = t.node JOIN nodes n ON n.label = u.label AND n.block = u.block AND n.node = u.node AND n.name IS NOT NULL), tips AS (SELECT label, block, key, '__' || string_agg(name, '_' ORDER BY name) AS name FROM ins GROUP BY label, block, node, key UNION ALL SELECT n.label, n.block, n.key, n.name FROM nodes n WHERE n.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ins i WHERE i.label = n.label AND i.block = n.block AND i.name = n.name)) SELECT label, block, name, (row_number() OVER (PARTITION BY label, block ORDER BY key) - 1)::INT AS rank FROM tips",
    "fasta_round_trip": f"WITH {SQL_DENSE} SELECT name, string_agg(ch, '' ORDER BY pos) AS seq FROM sites GROUP BY ALL",
    "stockholm_scan": f"WITH {SQL_DENSE} SELECT label || ':' || block AS file, name, string_agg(CASE WHEN pos % 5 = 4 THEN lower(ch) ELSE ch END, '' ORDER BY pos) AS seq, count(*) FILTER (pos % 5 <> 4) AS original FROM sites GROUP BY ALL",
    "search_report_scan": "WITH h AS (SELECT user_id AS fragment, event_type AS subset, max(value) AS b, min(value) AS e FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT subset, fragment, printf('%.3f', e)::DOUBLE AS evalue, printf('%.2f', b)::DOUBLE AS bitscore FROM h WHERE b IS NOT NULL AND e IS NOT NULL",
    "edge_leaf_counts": f"WITH {TL} SELECT label, block, node, leaves, total FROM lv",
    "root_distances": f"WITH {TD} SELECT label, block, node, round(d, 6) AS dist, length(key) - 1 AS depth FROM dist JOIN nodes USING (label, block, node)",
    "centroid_edge": f"WITH {TL} SELECT label, block, node, leaves, total FROM (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY abs(total / 2.0 - leaves), key) AS r FROM lv WHERE parent IS NOT NULL AND leaves >= 2 AND total - leaves >= 2) WHERE r = 1",
    "longest_edge": f"WITH {TL} SELECT label, block, node, leaves FROM (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY length DESC, key) AS r FROM lv WHERE parent IS NOT NULL AND leaves >= 2 AND total - leaves >= 2) WHERE r = 1",
    "clade_edge": f"WITH {TL} SELECT label, block, node, leaves FROM lv WHERE node = 2",
    "product_edge": f"WITH {TL}, hv AS (SELECT *, row_number() OVER (PARTITION BY label, block, parent ORDER BY leaves DESC, key) AS r FROM lv WHERE parent IS NOT NULL), ok AS (SELECT h.* FROM hv h WHERE NOT EXISTS (SELECT 1 FROM up u JOIN hv g ON g.label = u.label AND g.block = u.block AND g.node = u.anc WHERE u.label = h.label AND u.block = h.block AND u.node = h.node AND g.r > 1)) SELECT label, block, node, leaves, total FROM (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY leaves * (total - leaves) DESC, key DESC) AS q FROM ok) WHERE q = 1",
    "bisected_leaves": f"WITH {TL}, cut_ AS (SELECT label, block, node AS c FROM (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY abs(total / 2.0 - leaves), key) AS r FROM lv WHERE parent IS NOT NULL AND leaves >= 2 AND total - leaves >= 2) WHERE r = 1) SELECT n.label, n.block, n.name, count(u.anc) > 0 AS below FROM nodes n JOIN cut_ USING (label, block) LEFT JOIN up u ON u.label = n.label AND u.block = n.block AND u.node = n.node AND u.anc = c WHERE n.name IS NOT NULL GROUP BY ALL",
    "adjacent_edges": f"WITH {T}, e AS (SELECT label, block, node AS edge, unnest([node, parent]) AS at FROM nodes WHERE parent IS NOT NULL) SELECT DISTINCT x.label, x.block, x.edge AS a, y.edge AS b FROM e x JOIN e y ON x.label = y.label AND x.block = y.block AND x.at = y.at AND x.edge <> y.edge",
    "leaf_distance": f"WITH {PAIRS} SELECT label, block, a, b, round(d, 6) AS d FROM ld",
    "tree_diameter": f"WITH {PAIRS} SELECT label, block, round(max(d), 6) AS diameter FROM ld GROUP BY ALL",
    "nearest_taxa": f"WITH {PAIRS}, bw AS (SELECT label, block, a, d FROM ld UNION ALL SELECT label, block, b, d FROM ld) SELECT label, block, a AS name, rank, round(d, 6) AS d FROM (SELECT *, (row_number() OVER (PARTITION BY label, block, a ORDER BY d))::INT AS rank FROM bw) WHERE rank <= 3",
    "lca_pairs": f"WITH {T}, lf AS (SELECT *, lag(node, 3) OVER (PARTITION BY label, block ORDER BY key) AS a FROM nodes WHERE name IS NOT NULL) SELECT l.label, l.block, l.name::BIGINT AS name, max(u.anc) AS node FROM lf l JOIN up u ON u.label = l.label AND u.block = l.block AND u.node = l.node JOIN up v ON v.label = l.label AND v.block = l.block AND v.node = l.a AND v.anc = u.anc GROUP BY ALL",
    "lca_of_sets": f"WITH {T}, m AS (SELECT label, block, node, name::BIGINT % 7 AS set_id FROM nodes WHERE name IS NOT NULL), s AS (SELECT label, block, set_id, count(*) AS n FROM m GROUP BY ALL) SELECT label, block, set_id, max(anc) AS node FROM (SELECT label, block, set_id, anc, count(*) AS n FROM m JOIN up USING (label, block, node) GROUP BY ALL) JOIN s USING (label, block, set_id, n) GROUP BY ALL",
    "long_branches": f"WITH {T}, lf AS (SELECT *, row_number() OVER (PARTITION BY label, block ORDER BY length, key) - 1 AS r, count(*) OVER (PARTITION BY label, block) AS c FROM nodes WHERE name IS NOT NULL AND length IS NOT NULL), md AS (SELECT label, block, length AS median FROM lf WHERE r = c // 2) SELECT label, block, name::BIGINT AS name, length, median FROM lf JOIN md USING (label, block) WHERE length > 3.0 * median",
    "pruned_trees": f"WITH {T}, kept AS (SELECT * FROM nodes WHERE name IS NOT NULL AND name::BIGINT % 3 <> 0), below AS (SELECT u.label, u.block, u.anc AS node, min(k.key) AS lo, max(k.key) AS hi, count(*) AS n FROM kept k JOIN up u USING (label, block, node) GROUP BY ALL), grp AS (SELECT label, block, lo, hi, n, sum(length) AS length FROM below JOIN nodes USING (label, block, node) GROUP BY ALL) SELECT k.label, k.block, k.name::BIGINT AS name, (SELECT count(*) FROM grp g WHERE g.label = k.label AND g.block = k.block AND g.lo <= k.key AND g.hi >= k.key)::INT - 1 AS depth, round(g.length, 6) AS length FROM kept k JOIN grp g ON g.label = k.label AND g.block = k.block AND g.lo = k.key AND g.hi = k.key",
    "binary_trees": f"WITH {T} SELECT DISTINCT label, block, true AS binary FROM nodes",
    "scaled_lengths": f"WITH {T} SELECT label, block, node, length * 2.5 AS length FROM nodes",
    "labelled_nodes": f"WITH {T} SELECT label, block, count(*) AS names, count(*) FILTER (name IS NULL) AS fresh FROM nodes GROUP BY ALL",
    "newick_round_trip": f"WITH {T} SELECT label, block, name::BIGINT AS name, (row_number() OVER (PARTITION BY label, block ORDER BY key) - 1)::INT AS rank, round(length, 6) AS length FROM nodes WHERE name IS NOT NULL",
    "split_relabel": f"WITH {two()}, o AS (SELECT label, block, canon, min(node) AS other FROM bk WHERE node > 1 GROUP BY ALL) SELECT k.label, k.block, k.node, o.other FROM k LEFT JOIN o USING (label, block, canon) WHERE k.node > 1",
    "merged_placements": f"WITH {two()}, o AS (SELECT label, block, canon, min(node) AS other FROM bk WHERE node > 1 GROUP BY ALL) SELECT k.label, k.block, n.name::BIGINT AS fragment, other AS edge, round(CASE WHEN 0.1 > m.length THEN m.length * 0.99 ELSE 0.1 END, 6) AS distal FROM k JOIN nodes n USING (label, block, node) JOIN o USING (label, block, canon) JOIN bnodes m ON m.label = k.label AND m.block = k.block AND m.node = o.other WHERE k.node > 1 AND n.name IS NOT NULL",
    "edge_taxa": f"WITH {T}, h AS (SELECT u.label, u.block, u.anc AS node, count(DISTINCT n_nationkey) AS n1, count(DISTINCT n_regionkey) AS n2, min(n_nationkey) AS a, min(n_regionkey) AS r FROM up u JOIN nodes n USING (label, block, node) JOIN nation ON n_nationkey = n.name::BIGINT % 25 WHERE n.name IS NOT NULL GROUP BY ALL) SELECT label, block, node, CASE WHEN n1 = 1 THEN 'n' || a WHEN n2 = 1 THEN 'r' || r ELSE 'root' END AS tax_id FROM h WHERE node > 1",
    "classified_placements": f"WITH {T}, {TAXA}, pl AS (SELECT label, block, name::BIGINT AS fragment, node AS edge, length + 0.1 AS w FROM nodes WHERE name IS NOT NULL AND parent > 1 UNION ALL SELECT label, block, name::BIGINT, parent, 0.5 FROM nodes WHERE name IS NOT NULL AND parent > 1), pp AS (SELECT *, w / sum(w) OVER (PARTITION BY fragment) AS p FROM pl), r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY fragment ORDER BY p DESC, edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pp), kept AS (SELECT r.*, h.* EXCLUDE (label, block, node) FROM r JOIN h ON h.label = r.label AND h.block = r.block AND h.node = r.edge WHERE before < 0.9 AND p > 0.05), lines AS (SELECT fragment, p, CASE WHEN n1 = 1 THEN ['n' || a, 'r' || r_, 'root'] WHEN n2 = 1 THEN ['r' || r_, 'root'] ELSE ['root'] END AS ids FROM kept), every_ AS (SELECT fragment, p, unnest(ids) AS id FROM lines) SELECT fragment, id, upper(id) AS name, CASE id[1] WHEN 'n' THEN 'nation' WHEN 'r' THEN CASE WHEN id = 'root' THEN 'root' ELSE 'region' END END AS rank, printf('%.4f', sum(p)) AS prob FROM every_ GROUP BY ALL HAVING sum(p) >= 0.5",
    "insertion_trees": f"WITH {TD} SELECT label, block, n.name, round(d, 6) AS dist FROM nodes n JOIN dist USING (label, block, node) WHERE n.name IS NOT NULL UNION ALL SELECT n.label, n.block, 'q' || n.name, round(CASE WHEN n.name::BIGINT % 3 = 0 THEN x.d - n.length / 2 ELSE y.d - least(n.name::BIGINT % 7 * 0.01, m.length) END + 0.25, 6) FROM nodes n JOIN nodes m ON m.label = n.label AND m.block = n.block AND m.node = n.parent JOIN dist x ON x.label = n.label AND x.block = n.block AND x.node = n.node JOIN dist y ON y.label = n.label AND y.block = n.block AND y.node = n.parent WHERE n.name IS NOT NULL AND n.parent > 1 AND n.name::BIGINT % 3 < 2",
    "transferred_labels": f"WITH {two()}, o AS (SELECT label, block, canon, min('N' || node) AS name FROM k WHERE node > 1 AND len(s) > 1 GROUP BY ALL) SELECT bk.label, bk.block, bk.node, o.name FROM bk JOIN o USING (label, block, canon) WHERE len(bk.s) > 1",
    "missed_labels": f"WITH {two()} SELECT k.label, k.block, 'N' || k.node AS name FROM k WHERE k.node > 1 AND len(s) > 1 AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.label = k.label AND bk.block = k.block AND bk.canon = k.canon AND bk.node > 1)",
    "shared_splits": f"WITH {two()}, x AS (SELECT DISTINCT label, block, canon, 1 AS a FROM k WHERE node > 1 AND len(s) > 1 AND len(r) > 1), y AS (SELECT DISTINCT label, block, canon, 1 AS b FROM bk WHERE node > 1 AND len(s) > 1 AND len(r) > 1) SELECT label, block, count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM x FULL JOIN y USING (label, block, canon) GROUP BY ALL",
    "edge_support": f"WITH {TRIO()}, every_ AS (SELECT DISTINCT label, block, 0 AS t, canon FROM k WHERE node > 1 UNION ALL SELECT DISTINCT label, block, 1, canon FROM bk WHERE node > 1 UNION ALL SELECT DISTINCT label, block, 2, canon FROM ck WHERE node > 1), held AS (SELECT label, block, canon, count(*) AS n FROM every_ GROUP BY ALL) SELECT label, block, node, round(n / 3.0, 6) AS support FROM k JOIN held USING (label, block, canon) WHERE node > 1 AND len(s) > 1 AND len(r) > 1",
    "incompatible_splits": f"WITH {two()}, x AS (SELECT label, block, node, s, len(s) AS n FROM k WHERE node > 1 AND len(s) > 1), y AS (SELECT label, block, node AS m, s AS t, len(s) AS o FROM bk WHERE node > 1 AND len(s) > 1), bad AS (SELECT DISTINCT label, block, node FROM x JOIN y USING (label, block) WHERE len(list_intersect(s, t)) > 0 AND len(list_intersect(s, t)) < n AND len(list_intersect(s, t)) < o) SELECT a.label, a.block, count(bad.node) AS incompatible FROM (SELECT DISTINCT label, block FROM nodes) a LEFT JOIN bad USING (label, block) GROUP BY ALL",
    "same_leaf_sets": f"WITH {T} SELECT DISTINCT label, block, true AS same FROM nodes",
    "rerooted_trees": f"WITH {PAIRS} SELECT label, block, round(max(d), 5) AS diameter FROM ld GROUP BY ALL",
    "placement_normalise": f"WITH {W} SELECT fragment, edge_num, round(p, 6) AS p FROM p",
    "placement_threshold": f"WITH {W}, r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY fragment ORDER BY p DESC, edge_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, max(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY fragment ORDER BY p DESC, edge_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM p), k AS (SELECT * FROM r WHERE b < 0.6 AND stop = 0) SELECT fragment, edge_num, round(p, 6) AS p, round(p / (sum(p) OVER (PARTITION BY fragment) * count(*) OVER (PARTITION BY fragment)), 6) AS share FROM k",
    "best_placements": "SELECT l_orderkey AS fragment, l_suppkey AS edge_num, l_extendedprice AS lwr FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) AS r FROM lineitem) WHERE r = 1",
    "distal_clip": "SELECT l_orderkey AS fragment, round(sum(CASE WHEN l_quantity > 10 + s_nationkey THEN (10 + s_nationkey) * 0.99 ELSE l_quantity END), 4) AS distal, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "taxonomic_rollup": f"WITH {W}, t AS (SELECT fragment, unnest(['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey, 'root']) AS tax_id, p FROM p JOIN supplier ON s_suppkey = edge_num JOIN nation ON n_nationkey = s_nationkey) SELECT fragment, tax_id, round(sum(p), 6) AS p FROM t GROUP BY ALL",
    "classified_fragments": f"WITH {W}, t AS (SELECT fragment, unnest([{{'i': 's' || s_suppkey, 'r': 'supplier'}}, {{'i': 'n' || n_nationkey, 'r': 'nation'}}, {{'i': 'r' || n_regionkey, 'r': 'region'}}, {{'i': 'root', 'r': 'root'}}]) AS x, round(p, 6) AS p FROM p JOIN supplier ON s_suppkey = edge_num JOIN nation ON n_nationkey = s_nationkey) SELECT fragment, x.i AS id, upper(x.i) AS name, x.r AS rank FROM t GROUP BY ALL HAVING round(sum(p), 5) >= 0.7",
    "jplace_documents": "SELECT l_suppkey::VARCHAR AS doc_id, count(*) AS rows, count(DISTINCT l_orderkey) AS fragments, round(sum(l_extendedprice), 2) AS lwr, round(sum(l_quantity), 2) AS distal FROM lineitem GROUP BY ALL",
    "jplace_rows": "SELECT l_suppkey::VARCHAR AS doc_id, 'f' || l_orderkey % 50 AS fragment, l_orderkey::INT AS edge_num, -1.5::DOUBLE AS likelihood, l_extendedprice AS lwr, l_quantity AS distal_length, 0.25::DOUBLE AS pendant_length, 1.0::DOUBLE AS copies FROM lineitem",
    "jplace_faults": "SELECT s_suppkey::VARCHAR AS doc_id, CASE WHEN s_suppkey % 5 = 0 THEN 'malformed' WHEN s_suppkey % 7 = 0 THEN 'no fields' ELSE 'no text' END AS fault FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0",
    "event_properties": "SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}

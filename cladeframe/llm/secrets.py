"""Secret scan with a random forest that removes false positives. DataFrame functions only.

Candidates are runs of key characters and any value that a key word is assigned, with what stands before and after
them. A forest over their length, character
transitions, dictionary coverage, path and neighbouring words tells secrets from the rest. Trees grow level by level:
one aggregation gives the label counts of every (tree, node, feature, bin), and only these counts, whose number is
bounded by the forest's size, reach the driver, which chooses the splits. The grown forest is a Column expression, so
scanning is one pass over the text inside the row, without joins, shuffles or UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table, unit_hash

TRAIN_DOCS = 20_000
MADE_DOCS = 120
TREES, DEPTH, LEAST = 12, 4, 6
LEFT, RIGHT = 40, 24
RUN = "[A-Za-z0-9+/_-]"
# A run of 12 key characters with a digit among the first 64, or of 20 of any kind, with its surroundings.
CANDIDATE = rf"(?s)(?<!{RUN})(?={RUN}{{12}})(?={RUN}{{20}}|{RUN}{{0,63}}?[0-9])(?<=(^.{{0,{LEFT - 1}}}|.{{{LEFT}}}))({RUN}{{12,}}={{0,2}})(?=(.{{0,{RIGHT}}}))"

# Words before secrets, and before look-alikes of secrets.
KEY_WORDS = "passw|passwd|pwd|secret|token|api.?key|apikey|access.?key|private.?key|credential|auth|bearer"
PLAIN_WORDS = "commit|revision|sha-?[0-9]{1,3}|md5|checksum|digest|integrity|etag|uuid|guid|base64|image|build|version|count|hint"
# Any value of six or more characters that a key word is assigned, unless it is a candidate of the first kind.
ASSIGNED = "(?i:passw(?:or)?d|passphrase|passwd|pwd|secret|token|api[_-]?key|credential)[\"']?[ \\t]{0,2}[=:][ \\t]{0,2}[\"'`]?"
ASSIGNED_WORDS = ["passw", "passphrase", "pwd", "secret", "token", "api", "credential"]
ASSIGNED_VALUE = rf"(?s)(?<=[=:\"'` \t])(?<={ASSIGNED})(?!(?={RUN}{{12}})(?:{RUN}{{20}}|{RUN}{{0,63}}?[0-9]))(?<=(^.{{0,{LEFT - 1}}}|.{{{LEFT}}}))([^\s\"'`<>,;]{{6,}})(?=(.{{0,{RIGHT}}}))"

# Frequent word parts of English, French, German and Spanish, for dictionary coverage.
WORD_PARTS = (
    "the and ing tion that with for ent ion ers ter est ble ness ment able from this have our ight ould ance ence ous ive "
    "les des que pour dans elle eur eux eau aux ait ais ique ette ant ons "
    "der die das und ein sch ich ung heit keit lich schaft ver ber gen ten nen auf aus "
    "los las que para con ado ada dad mente ar er ir ando endo ero era on en er re an at or es st ed nd th ea ou he in ti ly ha"
).split()

# Split points of each feature.
CUTS = {
    "length": [14, 16, 18, 20, 21, 24, 32, 40, 41, 64, 96],
    "transitions": [1, 2, 3, 4, 6, 8, 12, 16, 24],
    "digits": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.99],
    "uppers": [0.01, 0.06, 0.15, 0.3, 0.5, 0.7, 0.9],
    "variety": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "words": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "path": [1, 2, 3],
    "symbols": [0.01, 0.1, 0.3],
    "key_left": [1],
    "plain_left": [1],
    "assigned": [1],
    "quoted": [1],
    "plain_next": [1],
}
FEATURES = list(CUTS)


def features(value: Column, left: Column, right: Column) -> Column:
    """Struct of all features of a candidate, as doubles."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    covered = n - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(set(WORD_PARTS), key=lambda w: (-len(w), w))), ""))
    url = left.rlike(r"(://|www\.)[^\s]*$").cast("int")
    path = F.regexp_count(value, F.lit("/")) + 2 * url + left.rlike(r"[./\\@]$").cast("int")
    made = {
        "length": n, "transitions": F.length(kinds), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "variety": F.size(F.array_distinct(F.split(F.lower(value), ""))) / n,
        "words": covered / n, "path": path, "symbols": share("[^A-Za-z0-9]"), "key_left": left.rlike(f"(?i)({KEY_WORDS})[^\\n]{{0,12}}$").cast("int"), "plain_left": left.rlike(f"(?i)({PLAIN_WORDS})[^\\n]{{0,12}}$").cast("int"), "assigned": left.rlike("[=:]\\s?[\"']?$").cast("int"),
        "quoted": (left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).cast("int"), "plain_next": right.rlike(r"^[.,;]?\s+\p{L}+").cast("int"),
    }
    return F.struct(*[F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES])


def candidates(text: str) -> Column:
    """Array of (value, lead, trail, f) for all candidates of a text column: runs of key characters in text order, then
    other assigned values in text order; empty for null text."""
    t = F.coalesce(F.col(text), F.lit(""))

    def found(pattern):
        group = lambda k: F.regexp_extract_all(t, F.lit(pattern), F.lit(k))
        return F.arrays_zip(group(2).alias("value"), group(1).alias("lead"), group(3).alias("trail"))

    low = F.lower(t)
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ASSIGNED_WORDS])
    runs, assigned = found(CANDIDATE), F.when(named & t.rlike(ASSIGNED), found(ASSIGNED_VALUE))
    both = F.concat(runs, F.coalesce(assigned, F.slice(runs, 1, 0)))
    return F.transform(both, lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), c["trail"].alias("trail"), features(c["value"], c["lead"], c["trail"]).alias("f")))


def format_label(value: Column, left: Column) -> Column:
    """1 or 0 for findings whose label their value's own format or an address before it settles, else null.

    1: an access-key id of the usual form. 0: natural words, dates and numbers that nothing is assigned, runs of one character, addresses.
    """
    return (
        F.when(value.rlike("^AKIA[0-9A-Z]{16}$"), 1)
        .when(value.rlike(r"^[A-Za-z]?[a-z]+(-[a-z]+)*$") | value.rlike(r"^[0-9+-]+$") & ~left.rlike("[=:]\\s?[\"']?$") | left.rlike(r"(://|www\.)\S*$") | value.rlike("^(.)\\1+$"), 0)
    )


# Findings whose label is known because they are made. (lead, kind of value, trail, label, left-out words)
MADE = [
    ('token = "', "hex40", '"', 1), ("api_key: ", "base64", "\n", 1), ("SECRET_KEY='", "base64", "'", 1), ("password=", "hex20", " and more", 1), ("access_key_id = ", "akia", "\n", 1),
    ("Authorization: Bearer ", "base64", "\n", 1), ('passwd: "', "symbols", '"', 1), ("password = ", "symbols", "\n", 1), ("API-KEY ", "upper40", " ", 1), ('"token": "', "dotted", '"', 1), ("password=", "digits", " and", 1), ("secret: ", "digits", "\n", 1),
    ("commit ", "hex40", "\nthen", 0), ("sha256:", "hex64", " ok", 0), ("see uuid=", "uuid", "&b", 0), ("data:image/png;base64,", "base64", "iVBO", 0), ("src=/assets/app-", "hex20", ".js", 0), ('ETag: "', "hex32", '"', 0),
    ('checksum = "', "hex40", '"', 0), ("token count: ", "digits", " in all", 0), ("password: ", "stars", "\n", 0), ("the ", "word", " of it", 0), ("call ", "digits", " now", 0), ("token: ", "word", " of it", 0), ("build ", "hex20", ", done", 0),
]
LEFT_OUT = [('db_password: "', "hex32", '"', 1), ("credentials = ", "base64", "\n", 1), ("auth_token=", "hex40", "&x", 1), ("MD5 ", "hex32", " of", 0), ("revision ", "hex40", ", by", 0), ("guid ", "uuid", " is", 0), ("integrity=sha384-", "base64", ">", 0)]


def made_findings(docs: DataFrame, id_col: str, made: list, most: int = MADE_DOCS) -> DataFrame:
    """(value, lead, trail, y): one finding of each made form for about `most` documents, whose ids give the values."""
    n = docs.select(id_col).count()
    keys = docs.where(unit_hash(F.col(id_col), seed=37) < F.lit(most / max(1, n))).select(F.col(id_col).cast("string").alias("key")).distinct()

    def value(kind: str, k: int) -> Column:
        seed = F.concat_ws(":", "key", F.lit(str(k)))
        h, long = F.sha1(seed), F.sha2(seed, 256)
        return {
            "hex40": h, "hex20": F.substring(h, 1, 20), "hex32": F.md5(seed), "hex64": long, "upper40": F.upper(h), "base64": F.base64(F.unhex(long)),
            "akia": F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(h, 1, 16), "abcdef", "QRSTUV"))), "symbols": F.concat(F.substring(F.base64(F.unhex(long)), 1, 6), F.lit("!"), F.substring(h, 1, 3), F.lit("@#")),
            "dotted": F.concat_ws(".", F.substring(F.base64(F.unhex(long)), 1, 12), F.substring(h, 1, 16), F.substring(F.base64(F.unhex(long)), 20, 14)),
            "uuid": F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
            "digits": F.translate(F.substring(h, 1, 16), "abcdef", "012345"), "stars": F.lit("********"), "word": F.translate(F.substring(h, 1, 22), "0123456789", "etaoinshrl"),
        }[kind]

    rows = F.array(*[F.struct(value(kind, k).alias("value"), F.lit(lead).alias("lead"), F.lit(trail).alias("trail"), F.lit(y).alias("y")) for k, (lead, kind, trail, y) in enumerate(made)])
    return keys.select(F.explode(rows).alias("x")).select("x.*")


def quality(findings: DataFrame, forest, least: float = 0.5) -> tuple[float, float]:
    """Precision and recall of a forest on labelled findings (value, lead, trail, y)."""
    told = findings.select("y", (forest_score(forest, features(F.col("value"), F.col("lead"), F.col("trail"))) >= least).alias("told"))
    right, said, real = told.agg(F.count_if(F.col("told") & (F.col("y") == 1)), F.count_if("told"), F.count_if(F.col("y") == 1)).first()
    return right / max(1, said), right / max(1, real)


def split_expr(tree: dict, node: int, get, leaf) -> Column:
    """Nested CASE of a tree: get(feature) is a Column; leaf(node) the value of a node without a split."""
    if node not in tree:
        return leaf(node)
    f, at = tree[node]
    return F.when(get(f) >= F.lit(float(at)), split_expr(tree, 2 * node + 1, get, leaf)).otherwise(split_expr(tree, 2 * node, get, leaf))


def grow(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, seed: int = 7) -> list[tuple[dict, dict]]:
    """A forest from labelled findings (id long, f struct, y 0/1): per tree its splits and its nodes' probabilities.

    Rows weigh 0 to 3 in each tree by a hash (a bootstrap), classes weigh the same; a node considers about half of
    the features, picked by hash. Ties go to the first feature and split point. Without labelled rows of both kinds
    the forest has no splits and every probability is the share of positives (0 without rows).
    """
    rows = cut(findings.select("id", "f", F.col("y").cast("int").alias("y")))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return [({}, {1: 1.0 if 1 in n else 0.0})] * trees
    forest: list[tuple[dict, dict]] = [({}, {}) for _ in range(trees)]
    weight = F.element_at(F.array(*[F.lit(w) for w in (0, 0, 0, 1, 1, 1, 2, 3)]), (F.pmod(F.xxhash64(F.lit(seed), "tree", "id"), F.lit(8)) + 1).cast("int"))
    even = F.when(F.col("y") == 1, F.lit(0.5 / n[1])).otherwise(F.lit(0.5 / n[0])) * (n[0] + n[1])
    bins = F.array(*[F.struct(F.lit(i).alias("feature"), sum(((F.col(f"f.{f}") >= c).cast("int") for c in CUTS[f]), F.lit(0)).alias("bin")) for i, f in enumerate(FEATURES)])
    for level in range(depth + 1):
        at = F.lit(None).cast("int")
        for t in reversed(range(trees)):
            at = F.when(F.col("tree") == t, split_expr(forest[t][0], 1, lambda f: F.col(f"f.{f}"), lambda node: F.lit(node))).otherwise(at)
        spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight * even).where("w > 0")
        spread = spread.withColumn("node", at).where(F.col("node") >= (1 << level)).withColumn("b", F.explode(bins))
        counts = spread.groupBy("tree", "node", "b.feature", "b.bin").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("all"), F.count("*").alias("rows")).collect()
        by: dict[tuple, dict[int, dict[int, tuple]]] = {}
        for c in counts:
            by.setdefault((c.tree, c.node), {}).setdefault(c.feature, {})[c.bin] = (c["pos"], c["all"], c["rows"])
        for (t, node), per in sorted(by.items()):
            splits, probs = forest[t]
            pos, total, size = (sum(v[i] for v in per[0].values()) for i in range(3))
            probs[node] = (pos + 0.5) / (total + 1)
            if level == depth or size < 2 * least or min(pos, total - pos) <= 0:
                continue
            best = (1e-9, None, None)
            for f in sorted(per, key=lambda f: (hash_order(seed, t, node, f), f))[: max(2, len(FEATURES) // 2)]:
                left = [0.0, 0.0, 0]
                for b, c in enumerate(CUTS[FEATURES[f]]):
                    left = [x + y for x, y in zip(left, per[f].get(b, (0, 0, 0)))]
                    right = [pos - left[0], total - left[1], size - left[2]]
                    if min(left[2], right[2]) >= least:
                        gini = lambda s: 2 * s[0] * (s[1] - s[0]) / s[1]
                        gain = gini((pos, total)) - gini(left) - gini(right)
                        if gain > best[0] + 1e-9:
                            best = (gain, FEATURES[f], c)
            if best[1]:
                splits[node] = best[1:]
    return forest


def hash_order(*parts: int) -> int:
    h = 1469598103934665603
    for p in parts:
        h = ((h ^ (p + 0x9E37)) * 1099511628211) & ((1 << 64) - 1)
        h ^= h >> 29
    return h


def forest_score(forest: list[tuple[dict, dict]], f: Column) -> Column:
    """Mean probability over the trees, as a Column over a struct of features."""
    each = [split_expr(splits, 1, lambda name: f[name], lambda node, p=probs: F.lit(round(p.get(node, p.get(node // 2, 0.0)), 6))) for splits, probs in forest]
    return F.round(sum(each[1:], each[0]) / len(each), 6)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, findings: DataFrame | None = None) -> list[tuple[dict, dict]]:
    """Train on labelled findings (value, lead, trail, y); rows whose y is null are ignored, repeated ones count once each.

    Without findings, which the tables here lack, they are made: values of known kinds in known surroundings, for about
    MADE_DOCS documents, and the candidates of about train_docs documents, picked by hash of the id, whose own format
    settles the label. No documents give a forest that finds nothing; columns beyond id and text are ignored.
    """
    if findings is None:
        n = docs.select(id_col).count()
        some = docs.where(unit_hash(F.col(id_col), seed=31) < F.lit(train_docs / max(1, n)))
        c = some.select(F.explode_outer(candidates(text_col)).alias("c")).where("c is not null").select("c.value", "c.lead", "c.f")
        labelled = c.withColumn("y", format_label(F.col("value"), F.col("lead")))
        made = made_findings(docs, id_col, MADE).withColumn("f", features(F.col("value"), F.col("lead"), F.col("trail")))
        labelled = labelled.unionByName(made.select("value", "lead", "f", "y"))
    else:
        labelled = findings.select("value", "lead", "trail", "y").withColumn("f", features(F.col("value"), F.col("lead"), F.col("trail")))
    labelled = labelled.where(F.col("y").isNotNull()).select(F.xxhash64("value", "lead").alias("id"), "f", "y")
    return grow(labelled)


def scan(docs: DataFrame, forest, text_col: str = "text", least: float = 0.5, out: str = "found") -> DataFrame:
    """docs with column `out`: array of (value, lead, score, secret) of all candidates of the whole text.

    Null and empty texts have none. A column of that name is replaced; all others stay.
    """
    rated = F.transform(candidates(text_col), lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), forest_score(forest, c["f"]).alias("score")))
    rated = F.transform(rated, lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), c["score"].alias("score"), (c["score"] >= least).alias("secret")))
    return docs.withColumn(out, rated)


def redact(docs: DataFrame, forest, text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced by `mark`, and count_col brought up to date where the text changed.

    Columns and rows stay as they are otherwise, repeated rows and nulls too. A secret that is part of another
    candidate is masked there as well; longer ones are masked first.
    """
    names = docs.columns
    found, hits = free_name(docs, "_found"), free_name(docs, "_hits")
    values = F.array_distinct(F.transform(F.filter(found, lambda c: c["secret"]), lambda c: c["value"]))
    out = scan(docs, forest, text_col, out=found).withColumn(hits, F.array_sort(values, lambda a, b: F.length(b) - F.length(a)))
    clean = F.aggregate(hits, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark)))
    out = out.withColumn(text_col, F.when(F.size(hits) > 0, clean).otherwise(F.col(text_col)))
    if count_col in names:
        out = out.withColumn(count_col, F.when(F.size(hits) > 0, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return out.select(*[F.col(f"`{c}`") for c in names])


def op10_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: doc_id, its place among the document's candidates, a masked value, score, secret."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), fit(docs))
    # Not posexplode: for that Spark would look for candidates a second time, to filter rows without any.
    each = found.select("doc_id", F.posexplode_outer("found").alias("place", "c")).where("place is not null")
    masked = F.concat(F.substring("c.value", 1, 4), F.lit("..."), F.length("c.value").cast("string"))
    return each.select("doc_id", "place", masked.alias("masked"), F.md5("c.value").alias("value_md5"), "c.score", "c.secret")

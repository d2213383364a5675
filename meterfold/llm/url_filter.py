"""URL filter: fixed rules, and path templates judged by the labels that the rules give.

``judge`` splits every url into host and path and applies the longest rule that fits. The
pages that a rule fits are labelled examples. For each host, the paths form a tree of
segments, in which digits are generalised at once. From the root down, the rare children of a
node, each with less than one page in ``most_children`` of the node's, are generalised to ``*``
where there are more than ``most_children`` of them, which stays so when all counts grow
together; labelled children whose blocked share does not differ from that of all their siblings
(two-proportion z test) are merged into ``~``. A template's purity is its blocked share smoothed
towards one half by ``smoothing`` examples; templates of at least ``reject`` are blocked, and
with them the pages that no rule fits. A template without labelled pages has the purity of its
nearest ancestor that has some, up to the host; on a host without labelled pages it stands at
one half and is allowed.

The tree is built on counts by host and path shape, so a host with a third of all pages is
added up before it is shuffled. Segments beyond ``depth`` fold into one. DataFrame functions
only.

A null url, or one without ``://``, has an empty host and path, fits no rule and shares one
template. Repeated rows are judged alike and count as often as they occur. Only page_id and
url are read.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import lower_ascii, stored

# The rules of the query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ALLOW, BLOCK = "allow", "block"


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    split = pages.select("page_id", rest.alias("_rest")).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    after = F.substring(F.col("_rest"), F.char_length("_host") + 1, F.char_length("_rest"))
    return split.select("page_id", lower_ascii(F.col("_host")).alias("host"), F.regexp_extract(after, r"^[^?#]*", 0).alias("path"))


def matched(rules: list[tuple[str, str, str]]):
    """Struct of the longest rule that fits and its verdict, or null. ``rules`` is a short list."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    cases = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in longest_first
    ]
    return F.coalesce(*cases)


def shape(depth: int):
    """The path's segments with digits generalised, as ``depth`` columns; the last holds all that follows."""
    plain = F.regexp_replace(F.regexp_replace("path", r"[0-9]+", "#"), r"(?:[A-Fa-f]*#[A-Fa-f]+){3,}#?[A-Fa-f]*", "{hex}")
    # After the limit, segments stay together.
    pieces = F.split(plain, "/", depth + 1)
    return [F.coalesce(F.get(pieces, F.lit(k)), F.lit("")).alias(f"_s{k}") for k in range(1, depth + 1)]


def templates(labelled: DataFrame, depth: int, most_children: int, z: float, smoothing: float, reject: float) -> DataFrame:
    """For each host and path shape (_s1.._s<depth>): its template, counts, purity and whether it is rejected."""
    shapes = [f"_s{k}" for k in range(1, depth + 1)]
    nodes = stored(labelled.groupBy("host", *shapes).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("_label").alias("_labelled"),
        F.coalesce(F.sum("_label"), F.lit(0)).alias("_blocked"),
        *(F.lit(0).cast("long").alias(c) for c in ("_al", "_ab")),  # of the nearest ancestor with labels
    ), "nodes")
    totals = [F.sum(c).alias(c) for c in ("_n", "_labelled", "_blocked")]
    above = ["host"]
    for k in range(1, depth + 1):
        child, named = f"_s{k}", f"_t{k}"
        children = nodes.groupBy(*above, child).agg(*totals)
        sizes = children.groupBy(*above).agg(F.sum("_n").alias("_pn"))
        rare = F.col("_n") * most_children < F.col("_pn")
        children = children.join(sizes, above).withColumn("_rare", rare.cast("long")).drop("_pn")
        parent = children.groupBy(*above).agg(
            F.sum("_rare").alias("_k"), F.sum("_labelled").alias("_pl"), F.sum("_blocked").alias("_pb")
        )
        seen = children.join(parent, above)
        variable = (F.col("_k") > most_children) & (F.col("_rare") == 1)
        share = F.col("_pb") / F.col("_pl")
        rest = F.col("_pl") - F.col("_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("_labelled") + 1 / rest))
        gap = F.abs(F.col("_blocked") / F.col("_labelled") - (F.col("_pb") - F.col("_blocked")) / rest)
        similar = (F.col("_labelled") > 0) & F.when(rest > 0, gap <= F.lit(z) * error).otherwise(F.lit(False))
        seen = seen.select(*above, child, F.when(variable, "*").when(F.coalesce(similar, F.lit(False)), "~").otherwise(F.col(child)).alias(named), "_pl", "_pb")
        nearest = {up: F.when(F.col("_pl") > 0, F.col(own)).otherwise(F.col(up)) for up, own in (("_al", "_pl"), ("_ab", "_pb"))}
        nodes = stored(nodes.join(seen, [*above, child]).withColumns(nearest).drop("_pl", "_pb"), "nodes")  # a level's plan would hold those above it several times
        above = [*above, named]
    whole = nodes.groupBy(*above).agg(F.sum("_labelled").alias("_tl"), F.sum("_blocked").alias("_tb"))
    blocked, labels = (F.when(F.col("_tl") > 0, F.col(own)).otherwise(F.col(up)) for own, up in (("_tb", "_ab"), ("_tl", "_al")))
    purity = (blocked + smoothing / 2) / (labels + smoothing)
    judged = nodes.join(whole, above).withColumn("purity", purity)
    path = F.concat(*(F.concat(F.lit("/"), F.col(f"_t{k}")) for k in range(1, depth + 1)))
    return judged.select("host", *shapes, F.regexp_replace(path, "/+$", "").alias("template"), "_n", "_labelled", "_blocked", "purity", (F.col("purity") >= reject).alias("rejected"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, depth: int = 4, most_children: int = 20,
    z: float = 1.96, smoothing: float = 2.0, reject: float = 0.8,
) -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every page."""
    split = parts(pages).withColumn("_rule", matched(rules))
    label = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == BLOCK).cast("long"))
    rows = split.select("page_id", "host", "path", "_rule", label.alias("_label"), *shape(depth))
    shapes = [f"_s{k}" for k in range(1, depth + 1)]
    bad = templates(rows, depth, most_children, z, smoothing, reject).filter("rejected").select("host", *shapes, F.lit(True).alias("_bad"))
    open_pages = rows.filter(F.col("_rule").isNull()).join(bad, ["host", *shapes], "left")
    columns = ["page_id", "host", "path"]
    by_rule = rows.filter(F.col("_rule").isNotNull()).select(*columns, F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"))
    by_tree = open_pages.select(*columns, F.lit(None).cast("string").alias("rule"), F.when(F.col("_bad"), BLOCK).otherwise(ALLOW).alias("verdict"))
    return reduce(DataFrame.unionByName, [by_rule, by_tree])

"""Line deduplication by a fixed-depth tree of line templates, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SALTS, keep, marked, named_apart, named_back, salt_of, salted_join, scratch

#: Stands for a variable field.
ANY = "<*>"


#: Lines that hold a token at a place, beyond which they are spread over several tasks.
HOT = 1000

#: Scripts that are written without blanks.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"

#: Ranges that hold all of them, which are quicker to look for.
MAYBE = "[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u19E0-\\u19FF\\u2E80-\\uFFFF\\x{10000}-\\x{10FFFF}]"


def _tokens(line: Column) -> Column:
    """Tokens of a line with single blanks between."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _any_of(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def host_lines(docs: DataFrame, depth: int) -> DataFrame:
    """One row per line that isn't empty: its document (rid), that one's template text (tid) and characters, place, size, key and leaf.

    A line's size is its tokens, in scripts without blanks half its characters if these are more. Lines of under
    four tokens have no variable fields, as little else would tell them apart. Patterns are only searched for in
    texts and lines that hold one of their characters.
    """
    single = F.regexp_replace("text", " *[\t\r\f\x0B][ \t\r\f\x0B]*| {2,}", " ")
    odd = F.col("text").rlike("[\t\r\f\x0B0-9]")
    text = F.when(F.col("text").contains("  ") | (F.col("odd") & _any_of(F.col("text"), ["\t", "\r", "\f", "\x0B"])), single).otherwise(F.col("text"))
    # begins at a token's start and never goes back, so that long tokens take linear time
    fields = lambda m: F.when(F.col("odd") & _any_of(m, "0123456789"), F.regexp_replace(m, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(m)
    counted = lambda m: F.struct(m.alias("m"), _tokens(m).alias("n"))
    line = lambda x: F.struct(F.when(x["n"] < 4, x["m"]).otherwise(fields(x["m"])).alias("m"), x["n"].alias("n"))
    trimmed = F.transform(F.transform(F.split(text, "\n"), F.trim), counted)
    whole = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text", odd.alias("odd"))
    whole = whole.select("rid", F.transform(trimmed, line).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda n, x: n + F.length(x["m"]))
    # once per document, below the explosion; the outer form adds no second look at the lines
    whole = whole.select("rid", F.xxhash64("a").alias("tid"), total.alias("total"), "a")
    rows = whole.select("rid", "tid", "total", F.posexplode_outer("a").alias("pos", "x")).where("x.n > 0")
    rows = rows.select("rid", "tid", "total", "pos", F.col("x.n").alias("n_tokens"), F.col("x.m").alias("m"))
    unspaced = (F.octet_length("m") > F.length("m")) & F.col("m").rlike(MAYBE) & F.col("m").rlike(UNSPACED)
    # few tokens for its bytes: only such a line can have more characters than twice its tokens; from 50 on, all sizes are alike
    size = F.when((F.col("n_tokens") < 50) & (F.octet_length("m") > 2 * F.col("n_tokens")), F.when(unspaced, F.greatest("n_tokens", (F.length("m") / 2).cast("int")))).otherwise(F.lit(None))
    leaf = F.concat_ws(" ", F.col("n_tokens").cast("string"), F.substring_index("m", " ", depth))
    return rows.select("rid", "tid", "total", "pos", "n_tokens", F.coalesce(size, "n_tokens").alias("size"), "m", F.unhex(F.md5("m")).alias("line"), F.unhex(F.md5(leaf)).alias("leaf"))


def boilerplate(lines: DataFrame, where: str, *, depth: int, similarity: int) -> DataFrame:
    """Keys of the lines whose template is in enough different documents, whatever stands beside it.

    Documents with the same masked text are one. A document more than half of whose characters are in lines
    that other texts hold too is most likely a near copy: all of these count as one document for a template.
    A leaf's lines are split into groups by their heaviest token beyond the first `depth`: the one that most
    documents of the leaf hold at its place, among those of two lines or more (of equals the first place, then
    the greatest token). A group's template has constants where one token is in more than half of the group's
    documents by line, else variable fields; lines belong to it if `similarity` percent of their tokens are
    constants, and its documents are counted once however many of its lines they hold.
    """
    several = F.min("tid") < F.max("tid")
    counts = lines.groupBy("line", "leaf").agg(several.alias("several"), F.first("n_tokens").alias("n_tokens"), F.first("size").alias("size"), F.count("*").alias("n"))
    counts = keep(counts, f"{where}/counts")
    # leaves of several lines may recur where no line does
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("s"), F.count("*").alias("k"), F.max("size").alias("size"))
    leaves = keep(leaves.where((F.col("k") > 1) & (F.col("s") >= least_hosts())).select("leaf"), f"{where}/leaves")
    some = marked(counts, "leaf", leaves, "leaf").where("_marked").drop("_marked")
    key = ["line", "leaf", "n_tokens", "size"]
    shared = keep(salted_join(some, leaves, ["leaf"], "line", "inner", merge=True).select(key), f"{where}/shared")
    # what other texts hold too, and what may recur: looked up once
    asked = counts.where("several").select(*key, F.lit(True).alias("several"), (F.col("n") >= least_hosts()).alias("candidate"))
    asked = asked.unionByName(shared.select(*key, F.lit(False).alias("several"), F.lit(True).alias("candidate")))
    asked = keep(asked.groupBy(key).agg(F.max("several").alias("several"), F.max("candidate").alias("candidate")), f"{where}/asked")
    some = marked(lines.select("rid", "tid", "total", "line", F.length("m").alias("chars")), "line", asked, "line").where("_marked").drop("_marked")
    held = keep(salted_join(some, asked, ["line"], "rid", "inner", merge=True), f"{where}/held")
    copies = held.where("several").groupBy("rid").agg((F.sum("chars") * 2 > F.first("total")).alias("copy")).where("copy").select("rid")
    copies = keep(copies, f"{where}/copies")
    seen = marked(held.where("candidate").select(*key, "rid", "tid"), "rid", copies, "rid")
    sure = seen.where("NOT _marked").withColumn("copy", F.lit(None).cast("boolean"))
    found = seen.where("_marked").join(copies.withColumn("copy", F.lit(True)).hint("merge"), "rid", "left")
    host = F.when(F.col("copy"), F.lit(0).cast("long")).otherwise(F.col("tid")).alias("host")
    seen = keep(sure.unionByName(found).select(*key, host).distinct(), f"{where}/seen")
    exact = seen.groupBy("line", "size").agg(F.count("*").alias("hosts"))
    exact = exact.where(F.col("hosts") >= least_hosts()).select("line")
    # leaf templates: only of leaves that are in enough documents as a whole; the text of each line once
    wide = seen.groupBy("leaf", "host").agg(F.max("size").alias("size")).groupBy("leaf").agg(F.max("size").alias("size"), F.count("*").alias("hosts"))
    wide = keep(wide.where(F.col("hosts") >= least_hosts()).select("leaf"), f"{where}/wide")
    some = marked(shared.where(F.col("n_tokens") > depth), "leaf", wide, "leaf").where("_marked").drop("_marked")
    shared = keep(salted_join(some, wide, ["leaf"], "line", "inner", merge=True).select("line", "leaf"), f"{where}/narrow")
    own = marked(lines.select("line", "m", "rid"), "line", shared, "line").where("_marked").drop("_marked")
    text = salted_join(own, shared.select("line"), ["line"], "rid", "inner", merge=True).groupBy("line").agg(F.first("m").alias("m"))
    weights = seen.groupBy("line", "leaf", "n_tokens", "size").agg(F.count("*").alias("docs"))
    tokens = F.posexplode(F.split("m", " ")).alias("at", "token")
    text = keep(text.join(weights.hint("merge"), "line"), f"{where}/text")
    places = text.select("line", "leaf", "docs", tokens).where(F.col("at") >= depth)
    heavy = keep(places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("w"), F.count("*").alias("k")).where("k > 1"), f"{where}/heavy")
    name = F.xxhash64("leaf", "at", "token").alias("name")
    known = marked(places.select("line", "leaf", "at", "token", name), "name", heavy.select(name), "name").where("_marked").drop("_marked")
    # sorted by the name, which is one number; what it stands for is compared besides
    right = heavy.select(name, F.col("leaf").alias("_leaf"), F.col("at").alias("_at"), F.col("token").alias("_token"), "w")
    # both sides ask one bitmap which names may be hot: only these are salted and repeated
    hot = heavy.where(F.col("k") > HOT).select(name)
    salt = F.when(F.col("_marked"), salt_of("line")).otherwise(0)
    known = marked(known, "name", hot, "name").withColumn("_salt", salt).drop("_marked")
    salts = F.when(F.col("_marked"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(right, "name", hot, "name").withColumn("_salt", F.explode(salts)).drop("_marked")
    found = known.join(right.hint("merge"), ["name", "_salt"]).where("leaf = _leaf AND at = _at AND token = _token")
    # the greatest weight, then the first place, as one number; a line has one token at a place
    best = F.max(F.col("w").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") - F.col("at")).alias("x")
    split = found.groupBy("line").agg(best)
    split = split.select("line", (F.pmod(-F.col("x"), F.lit(1 << 31).cast("decimal(10,0)"))).cast("int").alias("at"))
    chosen = F.md5(F.concat_ws(" ", F.hex("leaf"), (-F.col("at")).cast("string"), F.get(F.split("m", " "), F.col("at"))))
    text = keep(text.join(split.hint("merge"), "line").withColumn("grp", F.unhex(chosen)).drop("at"), f"{where}/grouped")
    # only groups of several lines that may be in enough documents: they are in no more than the sum of their lines'
    total = text.groupBy("grp").agg(F.sum("docs").alias("total"), F.count("*").alias("k"), F.max("size").alias("size"))
    total = keep(total.where((F.col("k") > 1) & (F.col("total") >= least_hosts())).select("grp", "total"), f"{where}/total")
    some = marked(text.drop("size"), "grp", total, "grp").where("_marked").drop("_marked")
    text = keep(salted_join(some, total, ["grp"], "line", "inner", merge=True), f"{where}/grouped_again")
    weight = text.select("grp", "docs", "total", tokens).where(F.col("at") >= depth).groupBy("grp", "at", "token").agg(F.sum("docs").alias("w"), F.first("total").alias("total"))
    # at most one token of a place has more than half
    constant = weight.where(F.col("w") * 2 > F.col("total"))
    constant = constant.groupBy("grp").agg(F.collect_list(F.concat_ws(" ", F.col("at").cast("string"), "token")).alias("constants"))
    own = salted_join(text, keep(constant, f"{where}/constants"), ["grp"], "line", "inner", merge=True)
    # by hashing: a look-up of each place in a map would take the square of a line's length
    equal = F.size(F.array_intersect(F.transform(F.split("m", " "), lambda t, i: F.concat_ws(" ", i.cast("string"), t)), "constants"))
    alike = own.where((equal + F.lit(depth)) * 100 >= F.col("n_tokens") * similarity).select("line", "grp")
    alike = keep(alike, f"{where}/alike")
    members = salted_join(marked(seen, "line", alike, "line").where("_marked").drop("_marked"), alike, ["line"], "host", "inner", merge=True)
    groups = members.groupBy("grp", "host").agg(F.min("size").alias("size")).groupBy("grp").agg(F.min("size").alias("size"), F.count("*").alias("hosts"))
    groups = groups.where(F.col("hosts") >= least_hosts()).select("grp")
    group = salted_join(alike, groups, ["grp"], "line", "inner", merge=True).select("line")
    return keep(exact.unionByName(group).distinct(), f"{where}/found")


def least_hosts() -> Column:
    """In how many different documents a line's template recurs at least: 20 below size 4, then 10 falling to 2 from size 50 on."""
    size = F.col("size")
    return F.when(size < 4, 20).otherwise(F.greatest(F.lit(2), 10 - F.floor((size - 4) * 8 / 46)))


def _without(docs: DataFrame, lines: DataFrame, found: DataFrame, where: str, counts: bool) -> DataFrame:
    """`docs` without the `lines` whose key is in `found`, and n_lines, n_dropped if asked."""
    some = marked(lines.select("rid", "pos", "line"), "line", found, "line").where("_marked").drop("_marked")
    dropped = salted_join(some, found, ["line"], "rid", "inner", merge=True).groupBy("rid").agg(F.collect_set("pos").alias("dropped"))
    dropped = keep(dropped, f"{where}/dropped")
    # documents that surely keep all lines aren't shuffled; the caller's columns go by numbers meanwhile
    apart, names = named_apart(docs, "text")
    at = names.index("doc_id")
    rows = marked(apart.withColumn("rid", F.xxhash64(f"_c{at}", "text")), "rid", dropped, "rid")
    touched = rows.where("_marked").join(dropped.hint("merge"), "rid", "left")
    rows = touched.unionByName(rows.where("NOT _marked").withColumn("dropped", F.lit(None).cast("array<int>")))
    # the lines once per row, so that taking one is no new split
    rows = rows.withColumn("lines", F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"), lambda i: F.get("lines", i))
    rows = rows.withColumn(f"_c{names.index('text')}", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if not counts:
        return named_back(rows, names)
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    out = rows.select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n not in ("n_lines", "n_dropped")), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    return out


def dedup_lines(docs: DataFrame, *, depth: int = 3, similarity: int = 80, counts: bool = True) -> DataFrame:
    """`docs` with the lines dropped whose template is in enough different documents, and n_lines, n_dropped if `counts`.

    Lines are what newlines separate; see `boilerplate` for templates and `least_hosts` for how often they recur. A
    line goes wherever it stands: blocks of lines, short lines and scripts without blanks too. Rows with the same
    doc_id and text count as one document, and copies of a host don't count. A null text stays null with 0 lines,
    an empty one is one empty line, which stays; a document all of whose lines recur becomes empty; very long
    texts and lines are read whole. An empty table gives an empty result. Other columns are kept, whatever their
    names; with `counts`, any named n_lines or n_dropped are replaced.
    """
    where = scratch(docs.sparkSession, "lines")
    lines = keep(host_lines(docs.select("doc_id", "text"), depth), f"{where}/lines")
    return _without(docs, lines, boilerplate(lines, where, depth=depth, similarity=similarity), where, counts)

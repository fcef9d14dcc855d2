"""Reply graph: backlinks, dangling quotes, bounded reply trees.

Edges never cross threads, and every join is on ``(thread_nr, post_nr)`` pairs, so the
shuffles spread over posts rather than threads: one huge thread still lands on many
tasks. A post quoted very often is a skewed join key, which AQE's skew join splits.
Backlink order (quoting post's document position, then quote position) is carried as
columns instead of ranked lists; tree paths are text keys that sort in
pre-order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import indent_line, is_source_request, rule_line, split_lines

def order_text(n):
    """A number >= 0 as text that sorts like the number, whatever its size: the count of its
    digits in two places, then the digits."""
    digits = n.cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), digits)


def path_segment(pos, quote_pos):
    return F.concat(order_text(pos), order_text(quote_pos))


def backlinks(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (quoted post, quoting post, quote) whose target exists.

    Columns: thread_nr, post_nr (quoted), backlink_nr (quoting), pos, quote_pos.
    Ordering a post's backlinks by ``(pos, quote_pos)`` gives the archive's list order.
    """
    targets = posts.select("thread_nr", F.col("post_nr").alias("quoted_nr"))
    return (edges.join(targets, ["thread_nr", "quoted_nr"], "inner")
            .select("thread_nr", F.col("quoted_nr").alias("post_nr"), F.col("post_nr").alias("backlink_nr"),
                    "pos", "quote_pos"))


def dangling_quotes(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Quotes whose target is not in the thread (deleted posts)."""
    targets = posts.select("thread_nr", F.col("post_nr").alias("quoted_nr"))
    return edges.join(targets, ["thread_nr", "quoted_nr"], "left_anti")


def backlink_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("thread_nr", "post_nr").agg(F.count(F.lit(1)).alias("n_backlinks"))


def _node_edges(posts: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Backlinks with the quoting post's own traits: has a message, has a file."""
    traits = (posts.select("thread_nr", F.col("post_nr").alias("backlink_nr"),
                           (F.col("post_msg") != "").alias("has_msg"))
              .join(files.select("thread_nr", F.col("post_nr").alias("backlink_nr"), F.lit(True).alias("has_file")),
                    ["thread_nr", "backlink_nr"], "left")
              .withColumn("has_file", F.coalesce("has_file", F.lit(False))))
    return (links.join(traits, ["thread_nr", "backlink_nr"], "inner")
            .select("thread_nr", F.col("post_nr").alias("parent_nr"), F.col("backlink_nr").alias("node_nr"),
                    path_segment(F.col("pos"), F.col("quote_pos")).alias("seg"), "has_msg", "has_file"))


def reply_tree(posts: DataFrame, links: DataFrame, files: DataFrame, roots: DataFrame,
               max_level: int = 3, cut: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every reply path below each root, depth <= ``max_level``.

    A node is *shown* iff its message is non-empty; the walk descends from a node iff it
    has backlinks, the next level is within bounds, and not (no message and a file).
    One join per level (a fixed number of rounds). Returns thread_nr, root_nr, level,
    path (pre-order sort key), node_nr, shown, and the columns of ``roots`` named in ``carry``.

    ``cut``: the edge table and each level are written once to the shared checkpoint
    folder, so level k is read (not recomputed) by level k+1 and by the final union, and
    the lineage of a round never includes the earlier rounds.
    """
    from threadlake.session import cut_lineage

    keep = cut_lineage if cut else (lambda df: df)
    e = keep(_node_edges(posts, links, files))
    frontier = keep(roots.select("thread_nr", F.col("post_nr").alias("parent_nr"), *carry)
                    .join(e, ["thread_nr", "parent_nr"])
                    .select("thread_nr", F.col("parent_nr").alias("root_nr"), F.lit(1).alias("level"),
                            F.col("seg").alias("path"), "node_nr", "has_msg", "has_file", *carry))
    levels = [frontier]
    for lvl in range(2, max_level + 1):
        go = frontier.where(F.col("has_msg") | ~F.col("has_file")) \
            .select("thread_nr", "root_nr", F.col("path").alias("ppath"), F.col("node_nr").alias("parent_nr"), *carry)
        frontier = keep(go.join(e, ["thread_nr", "parent_nr"])
                        .select("thread_nr", "root_nr", F.lit(lvl).alias("level"),
                                F.concat(F.col("ppath"), F.lit("/"), F.col("seg")).alias("path"),
                                "node_nr", "has_msg", "has_file", *carry))
        levels.append(frontier)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.select("thread_nr", "root_nr", F.col("level").cast("int").alias("level"), "path", "node_nr",
                      F.col("has_msg").alias("shown"), *carry)


def tree_lines(tree: DataFrame, posts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Report lines of the shown tree nodes: a rule, then each message line indented by level.

    Returns thread_nr, root_nr, key (sorts in report order), line, and the tree's columns ``carry``.
    """
    msgs = posts.select("thread_nr", F.col("post_nr").alias("node_nr"), "post_msg")
    shown = tree.where("shown").join(msgs, ["thread_nr", "node_nr"])
    lines = F.concat(F.array(F.struct(F.lit(0).alias("i"), rule_line(F.col("level")).alias("line"))),
                     F.transform(split_lines(F.col("post_msg")),
                                 lambda l, i: F.struct((i + 1).alias("i"), indent_line(l, F.col("level")).alias("line"))))
    x = shown.select("thread_nr", "root_nr", "path", *carry, F.explode(lines).alias("l"))
    return x.select("thread_nr", "root_nr",
                    F.concat(F.col("path"), F.lit("#"), order_text(F.col("l.i"))).alias("key"),
                    F.col("l.line").alias("line"), *carry)


def relevant_replies(posts: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """The root's message, each direct reply that has text (indented 5, whole message),
    and for replies that are source requests, every line of their own replies (indented 10).

    Returns thread_nr, root_nr, key, line.
    """
    from threadlake.session import cut_lineage

    # Each backlink with the quoting post's message, written once: both levels of replies are read off it.
    msgs = posts.select("thread_nr", "post_nr", "post_msg")
    said = cut_lineage(
        links.join(msgs.withColumnRenamed("post_nr", "backlink_nr"), ["thread_nr", "backlink_nr"]).where(F.col("post_msg") != "")
        .select("thread_nr", "post_nr", "backlink_nr", path_segment(F.col("pos"), F.col("quote_pos")).alias("seg"), "post_msg"))
    r = cut_lineage(roots.select("thread_nr", "post_nr"))
    own = r.join(msgs, ["thread_nr", "post_nr"]).where(F.col("post_msg") != "").select(
        "thread_nr", F.col("post_nr").alias("root_nr"), F.lit("0").alias("key"), F.col("post_msg").alias("line"))
    l1 = said.join(r, ["thread_nr", "post_nr"]).select("thread_nr", F.col("post_nr").alias("root_nr"), "backlink_nr", "seg", "post_msg")
    first = l1.select("thread_nr", "root_nr", F.concat(F.lit("1"), F.col("seg")).alias("key"),
                      F.concat(F.lit("> "), F.repeat(F.lit(" "), 5), F.col("post_msg")).alias("line"))
    req = cut_lineage(l1.where(is_source_request(F.col("post_msg"))).select(
        "thread_nr", "root_nr", F.col("seg").alias("pseg"), F.col("backlink_nr").alias("post_nr")))
    l2 = (req.join(said.withColumnRenamed("post_msg", "m2"), ["thread_nr", "post_nr"])
          .select("thread_nr", "root_nr", "pseg", "seg", F.posexplode(split_lines(F.col("m2"))).alias("i", "l")))
    second = l2.select("thread_nr", "root_nr",
                       F.concat(F.lit("1"), F.col("pseg"), F.lit("/"), F.col("seg"), F.lit("#"),
                                order_text(F.col("i"))).alias("key"),
                       F.concat(F.lit("> "), F.repeat(F.lit(" "), 10), F.col("l")).alias("line"))
    return own.unionByName(first).unionByName(second)

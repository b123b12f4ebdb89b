"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Sections are parted by an empty line, paragraphs by a line break; a paragraph's leaves end with
a sentence or after ``LEAF_CHARS`` characters. Roots are equal for equal texts; where roots
differ, differing section and paragraph digests lead to the edited leaves. Column expressions
only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import id_text, partitions, stored

LEAF_CHARS = 64
#: A leaf ends behind a sentence mark and a space, or LEAF_CHARS characters behind the last cut.
LEAF_CUT = rf"(?s)(?<=[.!?]\s)|(?<=\G.{{{LEAF_CHARS}}})"
#: Digits of a leaf's MD5 that stand in a fingerprint: 40 bits; paragraphs, sections and roots use whole digests.
LEAF_DIGITS = 10
EMPTY_LEAF = "d41d8cd98f"  # first digits of the MD5 of no bytes
#: Digits of the paragraph and section digests that trees are compared by.
BRANCH_DIGITS = 16


def leaf_tree(text: Column) -> Column:
    """Leaf digests by section and paragraph."""
    return F.transform(
        F.split(text, "\n\n"),
        lambda section: F.transform(
            F.split(section, "\n"),
            lambda paragraph: F.transform(F.split(paragraph, LEAF_CUT), lambda leaf: F.md5(leaf.cast("binary"))),
        ),
    )


def digest(parts: Column) -> Column:
    return F.md5(F.concat_ws("", parts).cast("binary"))


def with_tree(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Add root, section digests, paragraph digests by section, the short digests of all leaves, and these as branches."""
    tree, paragraphs, sections = f"_{prefix}tree", f"{prefix}paragraphs", f"{prefix}sections"
    short = lambda leaves: F.filter(F.transform(leaves, lambda x: F.substring(x, 1, LEAF_DIGITS)), lambda x: x != EMPTY_LEAF)
    cut = lambda d: F.substring(d, 1, BRANCH_DIGITS).alias("digest")
    branch = lambda p, j, i: F.struct(cut(p), short(F.get(F.get(tree, i), j)).alias("leaves"))
    return (
        df.withColumn(tree, leaf_tree(text))
        .withColumn(paragraphs, F.transform(tree, lambda s: F.transform(s, digest)))
        .withColumn(sections, F.transform(paragraphs, digest))
        .withColumn(f"{prefix}root", F.sha2(F.concat_ws("", sections).cast("binary"), 256))
        .withColumn(
            f"{prefix}branches",
            F.transform(
                sections,
                lambda s, i: F.struct(cut(s), F.transform(F.get(paragraphs, i), lambda p, j: branch(p, j, i)).alias("branches")),
            ),
        )
        .withColumn(f"{prefix}leaves", leaves_below(f"{prefix}branches"))
        .drop(tree)
    )


def leaves_below(branches: str) -> Column:
    return F.flatten(F.flatten(F.transform(branches, lambda s: F.transform(s["branches"], lambda p: p["leaves"]))))


def fingerprint(prefix: str = "") -> Column:
    """Root, then the leaves in order."""
    return F.concat_ws(":", F.col(f"{prefix}root"), F.concat_ws("", f"{prefix}leaves"))


def _differing(branches: Column, other: Column) -> Column:
    """Branches whose digest the other tree does not have at this level."""
    digests = F.transform(other, lambda x: x["digest"])
    return F.filter(branches, lambda x: ~F.array_contains(digests, x["digest"]))


def _below(branches: Column, name: str) -> Column:
    return F.flatten(F.transform(branches, lambda x: x[name]))


def with_likeness(df: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """1 for equal roots, else the share of leaves not lost where the trees differ.

    Only sections that the other tree lacks are opened, in these only the paragraphs that its open sections lack; leaves
    are compared below those alone. ``one`` and ``other`` are prefixes of ``with_tree``; the other tree may be absent.
    """
    b1, b2 = F.col(f"{one}branches"), F.col(f"{other}branches")
    df = df.withColumn("_s1", _differing(b1, b2)).withColumn("_s2", _differing(b2, b1))
    df = df.withColumn("_p1", _below(F.col("_s1"), "branches")).withColumn("_p2", _below(F.col("_s2"), "branches"))
    df = df.withColumn("_l1", _below(_differing(F.col("_p1"), F.col("_p2")), "leaves"))
    df = df.withColumn("_l2", _below(_differing(F.col("_p2"), F.col("_p1")), "leaves"))
    lost = F.size(F.array_except("_l1", "_l2")) + F.size(F.array_except("_l2", "_l1"))
    total = F.size(F.array_distinct(f"{one}leaves")) + F.size(F.array_distinct(f"{other}leaves"))
    share = F.when(total > 0, F.greatest(F.lit(0.0), 1 - lost / total)).otherwise(F.lit(0.0))
    value = F.when(F.col(f"{one}root") == F.col(f"{other}root"), F.lit(1.0)).when(F.col(f"{other}root").isNotNull(), share).otherwise(F.lit(0.0))
    return df.withColumn(name, value).drop("_s1", "_s2", "_p1", "_p2", "_l1", "_l2")


def differing_paragraphs(one: Column, other: Column) -> Column:
    """Indexes (section, paragraph) of ``one``'s paragraphs whose digests ``other`` does not have in that place."""
    return F.flatten(
        F.transform(
            one,
            lambda section, i: F.transform(
                F.filter(
                    F.transform(
                        section,
                        lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("digest")),
                    ),
                    lambda x: ~x["digest"].eqNullSafe(F.get(F.get(other, i), x["paragraph"])),
                ),
                lambda x: F.struct(x["section"], x["paragraph"]),
            ),
        )
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, the id before it in a ring of ascending ids, and how many characters of it the one before takes.

    Ids are dealt by range; each range is ordered by itself and only its first and last rows meet
    the other ranges, so no task orders the whole table.
    """
    spark = docs.sparkSession
    sized = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    dealt = sized.repartitionByRange(partitions(spark), "doc_id").select("doc_id", "n", F.spark_partition_id().alias("p"))
    dealt = stored(dealt, "ids")
    last = dealt.groupBy("p").agg(F.max(F.struct("doc_id", "n")).alias("last"))
    ring = Window.orderBy("p")  # one row for each range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = last.select("p", F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("before"))
    inside = Window.partitionBy("p").orderBy("doc_id")
    rows = dealt.withColumn("_previous", F.lag(F.struct("doc_id", "n")).over(inside)).join(F.broadcast(before), "p")
    rows = rows.withColumn("_previous", F.coalesce("_previous", "before"))
    return rows.select("doc_id", F.col("_previous.doc_id").alias("previous_id"), F.floor(F.col("_previous.n") / 4).cast("int").alias("take"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the tree's digests: root, sections, paragraphs, leaves, and the leaves by branch."""
    rows = id_text(docs, id_col, text_col)
    return with_tree(rows, F.col("text")).drop("text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document, and where the edit begins.

    ``edited_section`` and ``edited_paragraph`` number the first paragraph of the edited text that the document does not
    have in that place; null where the texts are equal.

    The edit puts the first characters of the next document (ascending id, the first after the
    last) in place of the last quarter. A null text is empty. Ids are unique; where an id repeats,
    each of its rows meets each row of the next id. A row with a null id has no next document and
    its quarter is cut off. Columns other than the two named are not read.
    """
    rows = id_text(docs, id_col, text_col)
    # Both joins deal the same rows by id, so that texts are shuffled once.
    named = rows.where("doc_id IS NOT NULL")
    placed = named.hint("merge").join(neighbours(rows).withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    heads = with_tree(placed, F.col("text"), "next_").select(
        F.col("previous_id").alias("_id"), F.expr("substring(text, 1, take)").alias("head"), "next_root", "next_branches"
    )
    both = named.hint("merge").join(heads, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    both = both.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    both = both.withColumn("n_chars", F.length("text")).withColumn("next_leaves", leaves_below("next_branches"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    both = both.withColumn("cut", cut).withColumn(
        "edited", F.expr("concat(substring(text, 1, n_chars - cut), substring(coalesce(head, ''), 1, cut))")
    )
    both = with_tree(with_tree(both, F.col("text")), F.col("edited"), "edited_")
    both = with_likeness(with_likeness(both, "", "edited_", "near_edited"), "", "next_", "near_next")
    place = F.get(differing_paragraphs(F.col("edited_paragraphs"), F.col("paragraphs")), F.lit(0))
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint().alias("fingerprint"),
        fingerprint("edited_").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        place["section"].alias("edited_section"),
        place["paragraph"].alias("edited_paragraph"),
    )

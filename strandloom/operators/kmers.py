"""The k-mer graph of variant phases, as tables of nodes and edges.

A node (s, w) is a word w of K alleles from variant s on, its first allele in
the highest bit; an edge (s, e) is a word of K+1 alleles and joins the node of
its first K to that of its last K. Every read also counts for the complement
of each word, so tables are symmetric under it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import shuffled, stored


def words(reads: DataFrame, k: int) -> DataFrame:
    """(chrom, s, w): each window of k consecutive calls without a gap."""
    along = W.partitionBy("chrom", "rid").orderBy("snp_idx")
    back = [(F.lag("allele", j).over(along), F.lag("snp_idx", j).over(along)) for j in range(1, k)]
    here = reads.select("chrom", "snp_idx", "allele", *[c.alias(f"{n}{j}") for j, pair in enumerate(back, 1) for c, n in zip(pair, "ap")])
    whole = reduce(lambda a, b: a & b, [(F.col(f"a{j}") >= 0) & (F.col(f"p{j}") == F.col("snp_idx") - j) for j in range(1, k)], F.col("allele") >= 0)
    word = reduce(lambda a, b: a + b, [F.col(f"a{j}") * (1 << j) for j in range(1, k)], F.col("allele"))
    return here.filter(whole).select("chrom", (F.col("snp_idx") - (k - 1)).alias("s"), word.cast("long").alias("w"))


def _counted(reads: DataFrame, k: int, name: str) -> DataFrame:
    mask = (1 << k) - 1
    half = words(reads, k).groupBy("chrom", "s", F.least("w", mask - F.col("w")).alias("w")).count()
    return half.select("chrom", "s", F.explode(F.array("w", mask - F.col("w"))).alias(name), F.col("count").alias("cnt"))


def pair_counts(reads: DataFrame) -> DataFrame:
    """(chrom, s, same, diff): reads with equal and with unequal alleles on variants s and s+1."""
    pairs = words(reads, 2).withColumn("equal", F.col("w").isin(0, 3).cast("long"))
    return pairs.groupBy("chrom", "s").agg(F.sum("equal").alias("same"), F.sum(1 - F.col("equal")).alias("diff"))


def kmer_nodes(reads: DataFrame, k: int) -> DataFrame:
    """(chrom, s, w, cnt)."""
    return _counted(reads, k, "w")


def kmer_edges(reads: DataFrame, k: int) -> DataFrame:
    """(chrom, s, e, cnt)."""
    return _counted(reads, k + 1, "e")


def endpoints(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Edges with the counts of the nodes they join, cnt_u and cnt_v; edges without one of them go."""
    u = nodes.select("chrom", "s", F.col("w").alias("u"), F.col("cnt").alias("cnt_u"))
    v = nodes.select("chrom", (F.col("s") - 1).alias("s"), F.col("w").alias("v"), F.col("cnt").alias("cnt_v"))
    ends = edges.withColumn("u", F.shiftright("e", 1)).withColumn("v", F.col("e").bitwiseAND((1 << k) - 1))
    return ends.join(u, ["chrom", "s", "u"]).join(v, ["chrom", "s", "v"])


def edge_patch(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(chrom, s, e, weight): all edges, and where a rank has none, one made between the nodes of greatest mean count.

    At equal means (rounded down) the least word wins; its complement comes with it.
    """
    mask, full = (1 << k) - 1, (1 << (k + 1)) - 1
    bare = nodes.select("chrom", "s").distinct().join(shuffled(edges.select("chrom", "s").distinct()), ["chrom", "s"], "left_anti")
    u = nodes.join(shuffled(bare), ["chrom", "s"], "left_semi").select("chrom", "s", F.col("w").alias("u"), F.col("cnt").alias("cnt_u"))
    v = nodes.select("chrom", (F.col("s") - 1).alias("s"), F.col("w").alias("v"), F.col("cnt").alias("cnt_v"))
    # u and v overlap in k-1 alleles.
    near = u.withColumn("mid", F.col("u").bitwiseAND(mask >> 1)).join(shuffled(v.withColumn("mid", F.shiftright("v", 1))), ["chrom", "s", "mid"])
    best = near.groupBy("chrom", "s").agg(F.max(F.struct(F.expr("(cnt_u + cnt_v) div 2").alias("weight"), (-(F.col("u") * 2 + F.col("v").bitwiseAND(1))).alias("e"))).alias("best"))
    made = best.select("chrom", "s", F.explode(F.array(-F.col("best.e"), full + F.col("best.e"))).alias("e"), F.col("best.weight").alias("weight"))
    return edges.select("chrom", "s", "e", F.col("cnt").alias("weight")).unionByName(made)


def edge_trim(weights: DataFrame, confident: int = 15, above: int = 2, below: int = 5) -> DataFrame:
    """Drop edges far lighter than the heaviest of their rank: less than half where that has weight 15, else less than a fifth."""
    most = weights.withColumn("_most", F.max("weight").over(W.partitionBy("chrom", "s")))
    times = F.when(F.col("_most") >= confident, above).otherwise(below)
    return most.filter(F.col("weight") * times >= F.col("_most")).drop("_most")


def degrees(weights: DataFrame, k: int, out: bool) -> DataFrame:
    """(chrom, s, w, degree): edges that leave (or reach) each node, where there is one."""
    node = (F.col("s"), F.shiftright("e", 1)) if out else (F.col("s") + 1, F.col("e").bitwiseAND((1 << k) - 1))
    return weights.filter("weight > 0").groupBy("chrom", node[0].alias("s"), node[1].alias("w")).agg(F.count("*").alias("degree"))


def isolated_node_reset(nodes: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """The nodes that some edge touches."""
    touched = degrees(weights, k, True).select("chrom", "s", "w").union(degrees(weights, k, False).select("chrom", "s", "w")).distinct()
    return nodes.join(shuffled(touched), ["chrom", "s", "w"], "left_semi")


def symmetry_check(weights: DataFrame, k: int) -> DataFrame:
    """Edges whose complement has another weight, or none. A sound graph gives no rows."""
    full = (1 << (k + 1)) - 1
    both = weights.select("chrom", "s", F.least("e", full - F.col("e")).alias("e"), "weight")
    return both.groupBy("chrom", "s", "e").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most")).filter("n <> 2 OR least <> most")


def graph_stats(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Per chromosome the number of nodes and of edges."""
    n = nodes.groupBy("chrom").agg(F.count("*").alias("n_nodes"))
    e = weights.filter("weight > 0").groupBy("chrom").agg(F.count("*").alias("n_edges"))
    return n.join(e, "chrom", "full").select("chrom", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def counted(reads: DataFrame, lengths: set[int]) -> DataFrame:
    """(chrom, k, s, w, cnt): the symmetric counts of words of several lengths, from one pass over the reads, as a table.

    What is built on it reads the counts, which are far fewer than the calls.
    """
    along, most = W.partitionBy("chrom", "rid").orderBy("snp_idx"), max(lengths)
    back = [(F.lag("allele", j).over(along).alias(f"a{j}"), F.lag("snp_idx", j).over(along).alias(f"p{j}")) for j in range(1, most)]
    here = reads.select("chrom", "snp_idx", F.col("allele").alias("a0"), *[c for pair in back for c in pair])
    whole, word, made = F.col("a0") >= 0, F.col("a0").cast("long"), []
    for k in range(1, most + 1):
        if k > 1:
            whole = whole & (F.col(f"a{k - 1}") >= 0) & (F.col(f"p{k - 1}") == F.col("snp_idx") - (k - 1))
            word = word + F.col(f"a{k - 1}") * (1 << (k - 1))
        if k in lengths:
            made.append(F.when(whole, F.struct(F.lit(k).alias("k"), (F.col("snp_idx") - (k - 1)).alias("s"), F.least(word, (1 << k) - 1 - word).alias("w"))))
    half = here.select("chrom", F.inline(F.array_compact(F.array(*made)))).groupBy("chrom", "k", "s", "w").count()
    both = F.array("w", F.expr("shiftleft(1L, k) - 1 - w"))
    return stored(half.select("chrom", "k", "s", F.explode(both).alias("w"), F.col("count").alias("cnt")))


def of_length(words: DataFrame, k: int, name: str = "w") -> DataFrame:
    """The words of one length of `counted`."""
    return words.filter(F.col("k") == k).select("chrom", "s", F.col("w").alias(name), "cnt")


def pairs_of(words: DataFrame) -> DataFrame:
    """`pair_counts` from a table that has words of two."""
    return of_length(words, 2).filter("w < 2").groupBy("chrom", "s").agg(F.sum(F.when(F.col("w") == 0, F.col("cnt")).otherwise(0)).alias("same"), F.sum(F.when(F.col("w") == 1, F.col("cnt")).otherwise(0)).alias("diff"))


def patched_graph(reads: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, weights after patching, and pair counts."""
    words = counted(reads, {2, k, k + 1})
    nodes = of_length(words, k)
    return nodes, edge_patch(nodes, of_length(words, k + 1, "e"), k), pairs_of(words)


def graph(reads: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and weights after patching and trimming."""
    nodes, patched, _ = patched_graph(reads, k)
    weights = edge_trim(patched)
    return isolated_node_reset(nodes, weights, k), weights


def node_id(s: Column, w: Column, k: int) -> Column:
    return s * (1 << k) + w


def next_node(w: Column, bit: Column, k: int) -> Column:
    return (w * 2 + bit).bitwiseAND((1 << k) - 1)


def previous_node(w: Column, bit: Column, k: int) -> Column:
    return F.shiftright(bit * (1 << k) + w, 1)


def complement(w: Column, k: int) -> Column:
    return w.bitwiseXOR(F.lit((1 << k) - 1))


def auto_k(reads: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(chrom, k, score, chosen): how well each K suits, by usable words, density and disconnection of its graph.

    The usable share is that of words of K calls without a gap. An edge counts if
    the word that it ends with is usable; a gap before that reads as 0. Without
    any disconnection the score is infinite, of the sign of what it divides; 0 by
    0 has no score. The greatest score above 0 is chosen, of equal ones that of
    the least K, and 2 if none is above 0.
    """
    along = W.partitionBy("chrom", "rid").orderBy("snp_idx")
    back = [F.col("allele"), *[F.lag("allele", j).over(along) for j in range(1, max(ks) + 1)]]
    here = reads.select("chrom", *[c.alias(f"a{j}") for j, c in enumerate(back)], *[F.lag("snp_idx", k).over(along).alias(f"s{k}") for k in ks])
    words, usable, edges = {}, {}, []
    for k in ks:
        words[k] = F.col(f"a{k - 1}").isNotNull()
        usable[k] = reduce(lambda a, b: a & b, [F.col(f"a{j}") >= 0 for j in range(k)])
        bits = reduce(lambda a, b: a + b, [(F.col(f"a{j}") == 1).cast("long") * (1 << j) for j in range(k + 1)])
        edges.append(F.when(usable[k] & F.col(f"a{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("s"), bits.alias("e"))))
    counted = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    shares = here.groupBy("chrom").agg(*[f(c[k]).alias(f"{n}{k}") for k in ks for n, c, f in (("words", words, counted), ("usable", usable, counted))])
    shares = shares.select("chrom", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"words{k}").alias("words"), F.col(f"usable{k}").alias("usable")) for k in ks])))
    found = here.select("chrom", F.inline(F.array_compact(F.array(*edges)))).distinct()
    ranks = found.groupBy("chrom", "k", "s").count().groupBy("chrom", "k").agg(F.sum("count").alias("edges"), F.count("*").alias("joined"))
    rows = shares.join(ranks, ["chrom", "k"], "left").na.fill(0, ["edges", "joined"]).join(reads.groupBy("chrom").agg((F.max("snp_idx") + 1).alias("n_snp")), "chrom")
    rows = rows.withColumn("ranks", F.col("n_snp") - F.col("k"))
    over = F.col("usable") / F.col("words") - F.col("edges") / (F.expr("shiftleft(2L, k)") * F.col("ranks"))
    apart = (F.col("ranks") - F.col("joined")) / F.col("ranks")
    infinite = F.when(over > 0, F.lit(float("inf"))).when(over < 0, F.lit(float("-inf")))
    made = rows.select("chrom", "k", F.when(apart != 0, 100 * over / (5 * apart)).otherwise(infinite).alias("score"))
    best = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("k")).alias("k")))).over(W.partitionBy("chrom"))  # a row for each K
    return made.withColumn("chosen", F.col("k") == F.coalesce(-best["k"], F.lit(2)))

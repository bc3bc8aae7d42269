"""Scores of communication, markers, gene sets, isoforms and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators.ranking import average_rank


def receiver_delta(states: DataFrame, baseline: str | None = None) -> DataFrame:
    """(state, gene, delta): levels (state, gene, value) less the baseline state's, or the median over states; a gene
    that a state lacks has level 0 there."""
    names = states.select("state").distinct()
    if baseline is None:
        n = names.agg(F.count("*").alias("_n"))  # as many states as there are labels
        nonzero = states.groupBy("gene").agg(F.sort_array(F.collect_list("value")).alias("_v")).crossJoin(F.broadcast(n))
        padded = F.sort_array(F.concat("_v", F.array_repeat(F.lit(0.0), (F.col("_n") - F.size("_v")).cast("int"))))
        at = lambda k: F.element_at(padded, k.cast("int"))
        base = nonzero.select("gene", ((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias("_b"))
    else:
        base = states.filter(F.col("state") == baseline).select("gene", F.col("value").alias("_b"))
    every = states.select("gene").distinct().crossJoin(F.broadcast(names))
    full = every.join(states, ["state", "gene"], "left").join(base, "gene", "left")
    return full.select("state", "gene", (F.coalesce("value", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("delta"))


def receiver_response(edges: DataFrame, delta: DataFrame, response: DataFrame, keys: list[str], support: int = 8) -> DataFrame:
    """edges with response_key, promotion (cosine of the receiver's delta and the key's response), response (that, not
    below 0), genes used, and the ``support`` genes that add most.

    An edge's key is the first of its columns ``keys`` that response (key, gene, weight) has.  Genes that only one side
    has don't count.
    """
    common = delta.select("gene").distinct().join(response.select("gene").distinct(), "gene")
    d = delta.join(common, "gene")
    r = response.filter("weight != 0").join(common, "gene")
    known = r.select("key").distinct()
    norms = lambda df, by, v: df.groupBy(by).agg(F.sqrt(F.sum(F.col(v) * F.col(v))).alias(f"_{v}"))
    products = d.join(r, "gene").withColumn("_p", F.col("delta") * F.col("weight"))
    best = F.slice(F.sort_array(F.collect_list(F.when(F.col("_p") > 0, F.struct((-F.col("_p")).alias("p"), "gene")))), 1, support)
    pairs = products.groupBy("state", "key").agg(F.sum("_p").alias("_dot"), best.alias("_best")).join(norms(d, "state", "delta"), "state").join(norms(r, "key", "weight"), "key")
    under = F.col("_delta") * F.col("_weight")
    pairs = pairs.select(
        F.col("state").alias("receiver"), F.col("key").alias("response_key"), F.when(under > 1e-12, F.col("_dot") / under).otherwise(0.0).alias("promotion"), F.transform("_best", lambda x: x["gene"]).alias("support_genes")
    )
    used = r.groupBy(F.col("key").alias("response_key")).agg(F.count("*").alias("genes_used"))
    e = edges
    for k in keys:
        e = e.join(known.select(F.col("key").alias(k), F.col("key").alias(f"_{k}")), k, "left")
    e = e.withColumn("response_key", F.coalesce(*(F.col(f"_{k}") for k in keys))).drop(*(f"_{k}" for k in keys))
    out = e.join(pairs, ["receiver", "response_key"], "left").join(used, "response_key", "left")
    zero = F.coalesce("promotion", F.lit(0.0))
    return out.withColumns({"promotion": zero, "response": F.greatest(zero, F.lit(0.0)), "genes_used": F.coalesce("genes_used", F.lit(0))})


def final_scores(edges: DataFrame, lr_weight: float = 0.55, response_weight: float = 0.30, promotion_weight: float = 0.15) -> DataFrame:
    """edges with scaled (lr by the largest lr), score within 0..1, and p_within: the share of the edge's lr_key whose lr
    is as large."""
    top = edges.agg(F.max("lr").alias("_top"))
    e = edges.crossJoin(F.broadcast(top)).withColumn("scaled", F.col("lr") / (F.col("_top") + 1e-12)).drop("_top")
    raw = F.col("scaled") * lr_weight + F.greatest("response", F.lit(0.0)) * response_weight + F.greatest("promotion", F.lit(0.0)) * promotion_weight
    own = Window.partitionBy("lr_key")
    rank = F.rank().over(own.orderBy(F.desc("lr")))
    return e.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), "p_within": rank / F.count("*").over(own)})


def edge_stability(full: DataFrame, part: DataFrame, key: list[str], k: int) -> DataFrame:
    """(shared, share): how many of the ``k`` best edges of all are among the ``k`` best of a part; ties by key."""
    best = lambda df: df.orderBy(F.desc("score"), *key).limit(k).select(*key)
    return best(full).join(best(part), key).agg(F.count("*").alias("shared")).withColumn("share", F.col("shared") / F.lit(float(k)))


def combined_rank(markers: DataFrame, by: str, most_p: float = 0.05) -> DataFrame:
    """(by, gene, rank_lfc, rank_p, combo) of up-regulated genes: the mean of both ranks; genes over ``most_p`` are ranked
    among the others first and dropped after that."""
    up = markers.filter("lfc > 0")
    rank = lambda *order: F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    r = up.withColumns({"rank_lfc": rank(F.desc("lfc"), F.asc("gene")), "rank_p": rank(F.asc("p"), F.asc("gene"))})
    return r.withColumn("combo", (F.col("rank_lfc") + F.col("rank_p")) / 2).filter(F.col("p") < most_p)


def welch(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """(state, gene, mean, rest, t, df): Welch's t of each state's cells against all others, zeros included."""
    n_all = obs.agg(F.count("*").alias("_n"))
    sizes = obs.groupBy("state").agg(F.count("*").alias("n1")).crossJoin(F.broadcast(n_all)).withColumn("n2", F.col("_n") - F.col("n1")).filter("n1 > 1 and n2 > 1")
    v = F.col("value").cast("double")
    m = matrix.join(obs.select("cell", "state"), "cell")
    own = m.groupBy("gene", "state").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("q1"))
    all_ = matrix.groupBy("gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = own.join(all_, "gene").join(F.broadcast(sizes), "state")
    c = F.col
    mean1, mean2 = c("s1") / c("n1"), (c("s") - c("s1")) / c("n2")
    var1 = (c("q1") - c("n1") * mean1 * mean1) / (c("n1") - 1) / c("n1")
    var2 = ((c("q") - c("q1")) - c("n2") * mean2 * mean2) / (c("n2") - 1) / c("n2")
    t = t.select("state", "gene", "n1", "n2", mean1.alias("mean"), mean2.alias("rest"), var1.alias("_a"), var2.alias("_b")).filter("_a + _b > 1e-12")
    df = (c("_a") + c("_b")) * (c("_a") + c("_b")) / (c("_a") * c("_a") / (c("n1") - 1) + c("_b") * c("_b") / (c("n2") - 1))
    return t.select("state", "gene", "mean", "rest", ((c("mean") - c("rest")) / F.sqrt(c("_a") + c("_b"))).alias("t"), df.alias("df"))


def rank_genes(scores: DataFrame, by: str, score: str, most: int) -> DataFrame:
    """The ``most`` genes of largest score in each group, in order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "gene"))
    return scores.withColumn("place", place).filter(F.col("place") <= most)


def set_overlaps(term_gene: DataFrame, query: DataFrame, background: DataFrame, least: int = 1) -> DataFrame:
    """(term, k, term_size, query_size, background, fold): query and sets are both cut to the background (gene); sets
    with under ``least`` genes in common drop out."""
    bg = background.select("gene").distinct()
    q, t = query.select("gene").distinct().join(bg, "gene"), term_gene.select("term", "gene").distinct().join(bg, "gene")
    one = bg.agg(F.count("*").alias("background")).crossJoin(q.agg(F.count("*").alias("query_size")))
    hits = t.join(q, "gene").groupBy("term").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    out = hits.join(t.groupBy("term").agg(F.count("*").alias("term_size")), "term").crossJoin(F.broadcast(one))
    return out.select("term", "k", "term_size", "query_size", "background", (F.col("k") / (F.col("query_size") * F.col("term_size") / F.col("background"))).alias("fold"))


def edge_tables(markers: DataFrame, universe: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, tf, a, b, c, d): 2x2 tables of a cluster's marker edges (cluster, tf, target) by source, against the
    universe of edges (tf, target); sources with under ``least`` marker edges drop out."""
    total = universe.groupBy("tf").agg(F.count("*").alias("_all"))
    n = universe.agg(F.count("*").alias("_n"))
    own = markers.groupBy("cluster", "tf").agg(F.count("*").alias("a"))
    size = markers.groupBy("cluster").agg(F.count("*").alias("_k"))
    t = own.filter(F.col("a") >= least).join(size, "cluster").join(total, "tf").crossJoin(F.broadcast(n))
    c = F.col
    return t.select("cluster", "tf", "a", (c("_k") - c("a")).alias("b"), (c("_all") - c("a")).alias("c"), (c("_n") - c("_k") - c("_all") + c("a")).alias("d"))


def informative_variants(counts: DataFrame, groups: list[str], driver: list[float], least: int = 100, least_rho: float = 0.7) -> DataFrame:
    """(variant, rho): variants with ``least`` reads in every group, and a Spearman correlation of the groups' alternate
    shares with the driver's of ``least_rho`` or more, either way.  counts is (variant, grp, alt, depth)."""
    d = F.create_map(*(x for g, v in zip(groups, driver) for x in (F.lit(g), F.lit(float(v)))))
    c = counts.filter(F.col("grp").isin(groups)).groupBy("variant", "grp").agg(F.sum("alt").alias("alt"), F.sum("depth").alias("depth"))
    deep = c.filter(F.col("depth") >= least).withColumns({"_v": F.col("alt") / F.col("depth"), "_d": d[F.col("grp")]})
    ranked = deep.withColumns({"_rv": average_rank(["variant"], "_v"), "_rd": average_rank(["variant"], "_d")})
    rho = ranked.groupBy("variant").agg(F.count("*").alias("_n"), F.corr("_rv", "_rd").alias("rho"))
    return rho.filter((F.col("_n") == len(groups)) & (F.abs("rho") >= least_rho) & ~F.isnan("rho")).select("variant", "rho")


def base_counts(reads: DataFrame, least_quality: int = 13) -> DataFrame:
    """(site, A, C, G, T, depth) of (site, base, quality): bases of ``least_quality``, other letters ignored."""
    ok = reads.filter((F.col("quality") >= least_quality) & F.col("base").isin(*"ACGT"))
    return ok.groupBy("site").agg(*(F.count_if(F.col("base") == b).alias(b) for b in "ACGT"), F.count("*").alias("depth"))


def discovered_variants(counts: DataFrame, reference: DataFrame, least_depth: int, least_alt: int, least_share: float) -> DataFrame:
    """(site, ref, alt, ref_n, alt_n, depth): per site the commonest base that isn't the reference's (site, ref), the
    first letter at a tie, where it passes the gates."""
    bases = F.array(*(F.struct((-F.col(b)).alias("n"), F.lit(b).alias("b")) for b in "ACGT"))
    t = counts.join(reference, "site").withColumn("_all", bases)
    best = F.array_min(F.filter("_all", lambda x: x["b"] != F.col("ref")))
    own = F.filter("_all", lambda x: x["b"] == F.col("ref"))[0]["n"]
    t = t.select("site", "ref", best["b"].alias("alt"), (-own).alias("ref_n"), (-best["n"]).alias("alt_n"), "depth")
    return t.filter((F.col("depth") >= least_depth) & (F.col("alt_n") >= least_alt) & (F.col("alt_n") / F.col("depth") >= least_share))


def point_biserial(values: DataFrame, carriers: DataFrame, feature: str) -> DataFrame:
    """(feature, variant, n1, n0, r) of values (sample, feature, value) with carriers (sample, variant, present)."""
    t = values.join(carriers, "sample")
    p = F.col("present").cast("double")
    g = t.groupBy(feature, "variant").agg(F.count_if("present").alias("n1"), F.count_if(~F.col("present")).alias("n0"), F.corr("value", p).alias("r"))
    return g.filter("n1 > 0 and n0 > 0 and r is not null and not isnan(r)")


def isoform_importance(counts: DataFrame, least: float = 5.0) -> DataFrame:
    """(junction, isoform, importance) of counts (junction, isoform, sample, reads): the mean over samples with ``least``
    junction reads of the isoform's share, adding up to 1; without such a sample, its share of all reads."""
    own, all_ = Window.partitionBy("junction", "sample"), Window.partitionBy("junction")
    one = counts.groupBy("junction", "isoform", "sample").agg(F.sum("reads").alias("reads"))
    t = one.withColumn("_n", F.sum("reads").over(own))
    ok = F.col("_n") >= least
    g = t.groupBy("junction", "isoform").agg(F.sum(F.when(ok, F.col("reads") / F.col("_n"))).alias("_s"), F.sum("reads").alias("_t"))
    g = g.withColumns({"_any": F.sum("_s").over(all_), "_all": F.sum("_t").over(all_)})
    pooled = F.when(F.col("_all") > 0, F.col("_t") / F.col("_all")).otherwise(0.0)
    return g.select("junction", "isoform", F.when(F.col("_any") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("_any")).otherwise(pooled).alias("importance"))


def changed_edges(edges: DataFrame, levels: DataFrame, floor: float, least: float) -> DataFrame:
    """(source, target, one, two, change): activities sqrt(source * target) of edges in two groups, levels
    (gene, grp 1 or 2, value) under ``floor`` being 0; kept if either is ``least`` or more."""
    v = levels.withColumn("value", F.when(F.col("value") >= floor, F.col("value")).otherwise(0.0))
    wide = v.groupBy("gene").agg(*(F.max(F.when(F.col("grp") == k, F.col("value"))).alias(f"v{k}") for k in (1, 2)))
    side = lambda name: wide.select(F.col("gene").alias(name), *(F.coalesce(f"v{k}", F.lit(0.0)).alias(f"{name}{k}") for k in (1, 2)))
    e = edges.select("source", "target").distinct().join(side("source"), "source").join(side("target"), "target")
    a = lambda k: F.sqrt(F.col(f"source{k}") * F.col(f"target{k}"))
    out = e.select("source", "target", a(1).alias("one"), a(2).alias("two"))
    return out.filter((F.col("one") >= least) | (F.col("two") >= least)).withColumn("change", F.col("two") - F.col("one"))


def _choose(n: Column, k: Column) -> Column:
    """How many ways there are to choose k of n, for n up to 20."""
    ok = (k >= 0) & (k <= n)
    least = lambda c: F.greatest(c, F.lit(0)).cast("int")
    return F.when(ok, F.factorial(least(n)) / (F.factorial(least(k)) * F.factorial(least(n - k)))).otherwise(0.0)


def credits(scores: DataFrame, player: str, cell: str, metrics: list[str], mode: str, bonus: float = 0.01) -> DataFrame:
    """(cell, player, value): each player's credit in a cell, metrics added up; a cell has at most 20 players.

    A coalition pays a member the place that the member has in it from below, equals counting as below; a member that is
    within ``bonus`` of the best counts as the best.  'shapley' is the mean pay over all orders of joining a coalition,
    'shapley_all_or_none' that of the best only.  Both follow from how many others are below a player and how many are
    below it with the bonus.  'rank' is the place among all, 'rank_all_or_none' the number of players for every metric
    that the last player by name leads, the same for all; in both only the last player has a bonus.
    """
    if mode not in ("shapley", "shapley_all_or_none", "rank", "rank_all_or_none"):
        raise ValueError(f"unknown mode {mode}")
    long = scores.select(cell, player, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("_m")).select(cell, player, "_m.metric", "_m.v")
    upto = lambda more: F.expr(f"count(*) over (partition by `{cell}`, metric order by v range between unbounded preceding and {more}D following)") - 1
    own = Window.partitionBy(cell, "metric")
    t = long.withColumns({"n": F.count("*").over(own), "p": upto(0.0), "k": upto(bonus), "last": F.max(player).over(own), "top": F.max("v").over(own)})
    c = F.col
    if mode.startswith("rank"):
        is_last = c(player) == c("last")
        place = F.when(is_last & (c("v") + bonus >= c("top")), c("n")).otherwise(c("p") + 1)
        if mode == "rank":
            return t.groupBy(cell, player).agg(F.sum(place).cast("double").alias("value"))
        won = t.groupBy(cell).agg((F.count_if(is_last & (place == c("n"))) * F.max("n")).cast("double").alias("value"))
        return scores.select(cell, player).join(won, cell)
    weight = lambda s: F.factorial(s) * F.factorial((c("n") - s - 1).cast("int")) / F.factorial(c("n").cast("int"))
    if mode == "shapley":
        pay = lambda s: _choose(c("n") - 1, s) + c("p") * _choose(c("n") - 2, s - 1) + (c("k") - c("p")) * _choose(c("k") - 1, s - 1)
    else:
        pay = lambda s: _choose(c("k"), s) * (s + 1)
    sizes = F.when(c("n") > 1, F.sequence(F.lit(1), (c("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(sizes, F.lit(0.0), lambda total, s: total + weight(s) * pay(s))
    return t.withColumn("_value", value).groupBy(cell, player).agg(F.sum("_value").alias("value"))


def reassigned(wins: DataFrame, cells: DataFrame, centroids: DataFrame, least_cells: int, least_share: float) -> DataFrame:
    """(cell, cluster): cells (cell, cluster, x: array) of clusters with under ``least_cells`` cells or a share of wins
    under ``least_share`` go to the nearest centroid (cluster, centroid) of the others, the first by name at a tie."""
    size = cells.groupBy("cluster").agg(F.count("*").alias("_n"))
    good = size.join(wins, "cluster", "left").filter((F.col("_n") >= least_cells) & (F.coalesce("share", F.lit(0.0)) >= least_share)).select("cluster")
    stay = cells.join(good, "cluster", "left_semi").select("cell", "cluster")
    homes = centroids.join(good, "cluster", "left_semi").select(F.col("cluster").alias("_to"), "centroid")  # a row per cluster
    away = F.aggregate(F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    moved = cells.join(good, "cluster", "left_anti").crossJoin(homes).groupBy("cell").agg(F.min(F.struct(away.alias("d"), "_to")).alias("_b"))
    return stay.unionByName(moved.select("cell", F.col("_b._to").alias("cluster")))


def allele_pairs(positions: DataFrame, alleles: DataFrame, least_depth: int = 8, balance: float = 0.15, least_minor: int = 3) -> DataFrame:
    """(gene, one, two, fits): the pair of alleles whose bases agree with what most positions show.

    positions is (gene, pos, A, C, G, T); a position's real bases are its commonest and a second with ``balance`` of the
    depth and ``least_minor`` reads.  alleles is (gene, allele, pos, base, frequency).  A gene has as many pairs as its
    known alleles squared; ties go by the sum of frequencies, then equal alleles, then names.
    """
    bases = F.sort_array(F.array(*(F.struct((-F.col(b)).alias("n"), F.lit(b).alias("b")) for b in "ACGT")))
    p = positions.withColumns({"_all": bases, "_depth": F.col("A") + F.col("C") + F.col("G") + F.col("T")}).filter(F.col("_depth") >= least_depth)
    second = F.col("_all")[1]
    minor = (-second["n"] / F.col("_depth") >= balance) & (-second["n"] >= least_minor)
    real = p.select("gene", "pos", F.col("_all")[0]["b"].alias("_x"), F.when(minor, second["b"]).otherwise(F.col("_all")[0]["b"]).alias("_y"))
    side = lambda n: alleles.select("gene", "pos", F.col("allele").alias(n), F.col("base").alias(f"_{n}"), F.col("frequency").alias(f"f_{n}"))
    pairs = real.join(side("one"), ["gene", "pos"]).join(side("two"), ["gene", "pos"]).filter("one <= two")
    same = ((F.col("_one") == F.col("_x")) & (F.col("_two") == F.col("_y"))) | ((F.col("_one") == F.col("_y")) & (F.col("_two") == F.col("_x")))
    g = pairs.groupBy("gene", "one", "two").agg(F.count_if(same).alias("fits"), F.first(F.col("f_one") + F.col("f_two")).alias("_f"))
    best = g.groupBy("gene").agg(F.min(F.struct((-F.col("fits")).alias("n"), (-F.col("_f")).alias("f"), (F.col("one") != F.col("two")).alias("h"), "one", "two")).alias("b"))
    return best.select("gene", "b.one", "b.two", (-F.col("b.n")).alias("fits"))


def best_rho(matrix: DataFrame, profile: DataFrame, rhos: list[float], top: int, penalty: float, slack: float) -> DataFrame:
    """(rho, benefit, removed, score, best): how much of the ``top`` ambient genes' share each rate of correction takes
    away, less ``penalty`` times the squared share of all counts that it removes; best marks the smallest rate within
    ``slack`` of the highest score.  Cells under the median total don't count."""
    total = matrix.groupBy("cell").agg(F.sum("value").alias("_t"))
    middle = total.agg(F.median("_t").alias("_m"))
    deep = total.crossJoin(F.broadcast(middle)).filter("_t >= _m").select("cell", "_t")
    ambient = profile.orderBy(F.desc("soup"), "gene").limit(top).select("gene", F.lit(1).alias("_top"))
    m = matrix.join(deep, "cell").join(profile, "gene", "left").join(ambient, "gene", "left")
    left = lambda r: F.greatest(F.lit(0.0), F.col("value") - F.col("_t") * F.coalesce("soup", F.lit(0.0)) * r)
    rates = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("rho"), left(r).alias("x")) for r in [0.0, *rhos])))
    per = m.select("_top", rates.alias("_r")).groupBy("_r.rho").agg(F.sum("_r.x").alias("_all"), F.coalesce(F.sum(F.when(F.col("_top") == 1, F.col("_r.x"))), F.lit(0.0)).alias("_amb"))
    base = per.filter("rho = 0").select(F.col("_all").alias("_all0"), (F.col("_amb") / F.col("_all")).alias("_share0"))
    c = F.col
    t = per.filter("rho > 0").crossJoin(F.broadcast(base))  # one row
    t = t.select("rho", ((c("_share0") - c("_amb") / c("_all")) / c("_share0")).alias("benefit"), ((c("_all0") - c("_all")) / c("_all0")).alias("removed"))
    t = t.withColumn("score", c("benefit") - c("removed") * c("removed") * penalty)
    near = t.agg(F.max("score").alias("_s")).crossJoin(t).filter(c("score") >= c("_s") - slack).agg(F.min("rho").alias("_best"))
    return t.crossJoin(F.broadcast(near)).select("rho", "benefit", "removed", "score", (c("rho") == c("_best")).alias("best"))

"""Roles of the operators played by the driver's tables: lineitem rows are evidence, customers' nation and segment the entity, parts the target, orders the reference with its date."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import scalars as S
from quillrank.operators import evidence, scoring, temporal

CUTOFF, SALT, K = "1999-06-30", "quill-1", 20
BASELINES = (scoring.POPULARITY, scoring.FINGERPRINT)
FOUR = (scoring.POPULARITY, scoring.SEQUENCE, scoring.FINGERPRINT, scoring.PAIR)


def pick(c: Column, cases: list, other=None) -> Column:
    """The case whose place is the number."""
    out = F.lit(other)
    for k, v in reversed(list(enumerate(cases))):
        out = F.when(c == k, v).otherwise(out)
    return out


class Binding:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def cutoff(self) -> Column:
        return F.lit(CUTOFF).cast("date")

    @cached_property
    def _items(self) -> DataFrame:
        """Measurements with their texts, before they meet anything else."""
        return self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", pick(F.col("l_linenumber") % 2, ["v2", "v3"]).alias("version"),
            pick(F.col("l_linenumber") % 5, ["Ki", "IC50", "Inhibition", "AC50", "EC50"]).alias("endpoint"), pick(F.col("l_quantity").cast("int") % 7, ["<"], "=").alias("relation"),
            pick(F.col("l_partkey") % 4, ["nM", "uM", " µM", "%"]).alias("unit"), F.when(F.col("l_quantity").cast("int") % 11 == 0, "n.d.").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"),
        )

    @cached_property
    def _orders(self) -> DataFrame:
        """References with their dates as texts."""
        turn, odate = F.col("o_orderkey") % 4, F.col("odate")
        return self.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("odate")).select(
            "*", pick(F.col("o_orderkey") % 11, ["DOI"], "PMID").alias("ref_kind"), F.col("o_orderkey").cast("string").alias("ref"), (F.col("o_orderkey") % 13 != 0).alias("found"),
            F.when(turn == 1, F.date_format(odate, "yyyy MMM")).when(turn == 2, F.date_format(odate, "yyyy")).otherwise(F.date_format(odate, "yyyy MMM dd")).alias("date_text"),
        )

    def _rows(self, items: DataFrame, orders: DataFrame, *more: str) -> DataFrame:
        customer = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        entity = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), "c_mktsegment")
        target = F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
        return joined.select(
            "version", entity.alias("entity"), target.alias("target"), S.pair_key(entity, target).alias("pair_key"), "ref_kind", "ref", "found", "odate", "date_text", "endpoint", "relation", "unit", "value",
            "p_name", "p_brand", "p_type", "p_size", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", *more,
        )

    @cached_property
    def rows(self) -> DataFrame:
        """Raw measurement rows."""
        return self._rows(self._items, self._orders)

    @cached_property
    def _tiered_items(self) -> DataFrame:
        texts = ["relation", "endpoint", "value", "unit"]
        found = evidence.by_text(self._items, texts, S.tier(*map(F.col, texts)))
        return found.withColumn("is_primary", F.substring("tier", 1, 2).isin("A_", "B_"))

    @property
    def _tier_columns(self) -> list[str]:
        return ["tier", "weight", "reason", "value_molar", "p_activity", "is_primary"]

    @cached_property
    def tiered(self) -> DataFrame:
        return self._rows(self._tiered_items, self._orders, *self._tier_columns)

    @cached_property
    def dated(self) -> DataFrame:
        d = S.partial_date(F.col("date_text"))
        found = evidence.by_text(self._orders, ["date_text"], d).withColumnRenamed("value", "date_value")
        orders = found.withColumn("published", F.when(F.col("precision") == "day", F.try_to_date("date_value", "yyyy-MM-dd")))
        return self._rows(self._tiered_items, orders, *self._tier_columns, "date_value", "precision", "published")

    @cached_property
    def membership(self) -> DataFrame:
        return evidence.version_membership(self.rows)

    @cached_property
    def screened(self) -> DataFrame:
        return temporal.pair_screen(self.dated.where("version = 'v3'"), self.cutoff)

    @cached_property
    def states(self) -> DataFrame:
        status = temporal.pre_cutoff_status(F.col("ref_kind"), F.col("ref"), F.col("precision"), F.col("published"), self.cutoff)
        rows = self.dated.withColumn("pre_cutoff_status", status).withColumn("is_strict", F.col("p_size") % 10 != 0)
        return evidence.pair_states_at_once(rows, self.cutoff)

    @cached_property
    def pairs(self) -> DataFrame:
        """Each pair's best tier up to the cutoff and after it, as places in evidence.BEST from 1: written once, since history and endpoint are read in several places."""
        from quillrank.operators.graph import shared

        old, rank = F.col("odate") <= self.cutoff, evidence.tier_rank(F.col("tier"))
        best = lambda c: F.min(F.when(c, rank))
        return shared(self.tiered.where("is_primary").groupBy("entity", "target").agg(best(old).alias("old"), best(~old).alias("new")), "pairs")

    def _graded(self, pairs: DataFrame, rank: str, entity: str = "entity") -> DataFrame:
        weights = F.create_map(*(F.lit(x) for pair in S.TIERS.items() for x in pair))
        named = pairs.select(F.col("entity").alias(entity), "target", F.element_at(F.array(*map(F.lit, evidence.BEST)), F.col(rank)).alias("tier"))
        return named.withColumn("weight", weights[F.col("tier")])

    @cached_property
    def history(self) -> DataFrame:
        """Best tier and weight of each pair up to the cutoff."""
        return self._graded(self.pairs.where("old IS NOT NULL"), "old")

    @cached_property
    def endpoint(self) -> DataFrame:
        """Pairs first seen after the cutoff: query, target, tier."""
        return self._graded(self.pairs.where("old IS NULL AND new IS NOT NULL"), "new", "query").drop("weight")

    @cached_property
    def queries(self) -> DataFrame:
        c = self.table("customer")
        return c.select(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), "c_mktsegment").alias("query")).distinct()

    @cached_property
    def targets(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("target"), "p_name", "p_brand", "p_type", "p_size")

    @cached_property
    def entity_similarity(self) -> DataFrame:
        from quillrank.operators import similarity
        from quillrank.operators.graph import shared

        bits = self.history.join(self.targets, "target").select("entity", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("bit")).distinct()
        return shared(similarity.tanimoto_join(bits.withColumnRenamed("entity", "query"), bits, "query", "entity"), "entity-similarity")  # read in several places

    @cached_property
    def names(self) -> DataFrame:
        return self.targets.select("p_name").distinct()

    @cached_property
    def name_history(self) -> DataFrame:
        """History with a target's text for the target: targets of one text are one sequence."""
        return self.history.join(self.targets.select("target", "p_name"), "target").groupBy("entity", F.col("p_name").alias("target")).agg(F.max("weight").alias("weight"))

    @cached_property
    def name_similarity(self) -> DataFrame:
        from quillrank.operators import similarity

        g = similarity.gram_weights(self.names, "p_name", "p_name")
        return similarity.cosine_join(g.withColumnRenamed("p_name", "target"), g.withColumnRenamed("p_name", "other"), "target", "other")

    def _features(self, names: tuple[str, ...]) -> dict[str, DataFrame]:
        return {"entity_similarity": self.entity_similarity} if scoring.FINGERPRINT in names else {}

    def ledger(self, names: tuple[str, ...] = BASELINES, history: DataFrame | None = None) -> DataFrame:
        return scoring.ledger(history or self.history, self.queries, self.targets, SALT, names, **self._features(names))

    @cached_property
    def universe_of_four(self) -> scoring.Universe:
        """The universe with all four baselines: what goes by a target's text is scored once for each text and query."""
        from quillrank.operators.graph import shared

        made = self._universe("p_type", "p_size", "p_name")
        pairs = made.rows.select(F.col("p_name").alias("target"), F.explode(F.arrays_zip("_entities", "_weights")).alias("_h"))
        history = shared(pairs.groupBy(F.col("_h._entities").alias("entity"), "target").agg(F.max("_h._weights").alias("weight")), "name-history")
        near = shared(self.name_similarity.withColumn("similarity", F.round("similarity", 9)), "name-similarity")
        sequence = scoring.score_sequence(history, self.queries, target_similarity=near)
        pair = scoring.score_pair_neighbour(history, self.queries, self.entity_similarity, near, neighbours=10)
        made.scored_by("p_name", {scoring.SEQUENCE: sequence.withColumnRenamed("target", "p_name"), scoring.PAIR: pair.withColumnRenamed("target", "p_name")})
        return made

    @cached_property
    def blocks_of_four(self) -> DataFrame:
        return self._blocks(self.universe_of_four)

    @cached_property
    def ranks_of_four(self) -> DataFrame:
        return self.universe_of_four.ledger(self.blocks_of_four, SALT)

    @cached_property
    def relevant_of_four(self) -> DataFrame:
        """As ``leading``: ranks are the ledger's up to K and for the first of each query and scope."""
        return self._leading(self.universe_of_four, self.blocks_of_four, self._asked_cells(self.universe_of_four), K)

    @cached_property
    def universe(self) -> scoring.Universe:
        return self._universe("p_type", "p_size")

    def _universe(self, *carried: str) -> scoring.Universe:
        """History and endpoint beside their targets, both from one exchange of the pairs."""
        # a null place is asked for first: element_at of literals counts as never null
        graded = lambda rank, values: F.when(F.col(rank).isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.col(rank)))
        future = F.when(F.col("old").isNull(), graded("new", evidence.BEST))
        made = scoring.Universe.beside(self.pairs, graded("old", [S.TIERS[t] for t in evidence.BEST]), future)
        rows = self.targets.select("target", *carried).join(made, "target", "left")
        return scoring.Universe(self.history, self.queries, self.targets, self.endpoint, self.entity_similarity, rows, carried)

    @cached_property
    def blocks(self) -> DataFrame:
        """Runs of equal scores, from counts of scores."""
        return self._blocks(self.universe)

    def _blocks(self, universe: scoring.Universe) -> DataFrame:
        from quillrank.operators import ranking
        from quillrank.operators.graph import shared

        return shared(ranking.counted_blocks(universe.runs()).select("baseline", "query", "score", "start", "end", "size"), "blocks")

    @cached_property
    def _relevant_cells(self) -> DataFrame:
        return self._asked_cells(self.universe)

    def _asked_cells(self, universe: scoring.Universe) -> DataFrame:
        """baseline, query, target, tier, p_type, p_size and score of the relevant cells, once for each baseline and not yet by scope; written with all scores in a row."""
        from quillrank.operators.graph import shared

        return scoring._long(shared(universe.both_asked(), "relevant"), universe.names, F.col("grade").alias("tier"), "p_type", "p_size")

    @property
    def relevant_scores(self) -> DataFrame:
        """The relevant cells by scope with their scores."""
        return self._by_scope(self._relevant_cells).select("baseline", "scope", "query", "target", "tier", "score")

    def leading(self, k: int = K) -> DataFrame:
        """``relevant`` with ranks that are the ledger's up to k and for the first of each query and scope; others are only known to be above these. No full ledger is ranked."""
        return self._leading(self.universe, self.blocks, self._relevant_cells, k)

    def _leading(self, universe: scoring.Universe, blocks: DataFrame, cells: DataFrame, k: int) -> DataFrame:
        from quillrank.operators import ranking
        from quillrank.operators.graph import shared

        asked = self._by_scope(cells).select("baseline", "scope", "query", "target", "tier", "score")
        limits = ranking.leading_limits(asked, blocks, k, ["scope"])
        limits = shared(ranking.tie_limits(asked, blocks, shared(limits, "limits"), k, ["scope"], SALT), "limits")
        ranks = ranking.leading_ranks(cells, blocks, universe.both_above(limits, SALT), SALT, limits=limits)
        return self._by_scope(ranks).select("baseline", "scope", "query", "target", "tier", "rank", "score")

    @cached_property
    def ranks(self) -> DataFrame:
        return self.universe.ledger(self.blocks, SALT)

    @cached_property
    def scoped(self) -> DataFrame:
        """The endpoint by nested scope."""
        return self._by_scope(self.endpoint.join(self.targets, "target")).select("scope", "query", "target", "tier", "p_type", "p_size")

    def _by_scope(self, rows: DataFrame) -> DataFrame:
        """Cold pairs by the target's type and brand, cold targets by thresholds of size."""
        from quillrank.operators import metrics

        cold = F.col("p_type").isin("PROMO", "SMALL", "LARGE")
        return metrics.scopes(rows, cold, {t: F.col("p_size") > n for t, n in (("0.30", 35), ("0.50", 20), ("0.70", 20))})

    @cached_property
    def relevant(self) -> DataFrame:
        return self.leading()

    @cached_property
    def relevant_ranks(self) -> DataFrame:
        """``relevant`` with every rank; all cells are ranked, but only the relevant ones leave the step."""
        return self.scoped.join(self.universe.ledger(self.blocks, SALT, asked=True), ["query", "target"]).select("baseline", "scope", "query", "target", "tier", "rank", "score")


#: DuckDB CTEs of the same roles, written apart from the operators.
EV = f"""
ev AS (
  SELECT *, CASE WHEN relation <> '=' OR value = 'n.d.' THEN 'D_censored_or_unresolved' WHEN endpoint = 'Ki' AND factor IS NOT NULL THEN 'A_affinity_candidate'
      WHEN endpoint IN ('IC50', 'EC50') AND factor IS NOT NULL THEN 'B_quantitative_functional_candidate' WHEN endpoint = 'Inhibition' THEN 'C_contextual_functional_exact' ELSE 'Q_unverified_screen_or_other_exact' END AS tier
  FROM (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'v2' ELSE 'v3' END AS version, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_mktsegment AS entity,
      'P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS target, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_mktsegment || '|P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS pair_key,
      CASE WHEN l_orderkey % 11 = 0 THEN 'DOI' ELSE 'PMID' END AS ref_kind, CAST(l_orderkey AS VARCHAR) AS ref, l_orderkey % 13 <> 0 AS found, CAST(o_orderdate AS DATE) AS odate,
      CASE l_orderkey % 4 WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'day' END AS precision,
      CASE l_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y %b') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y %b %d') END AS date_text,
      CASE l_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_value,
      CASE l_orderkey % 4 WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS lo,
      CASE l_orderkey % 4 WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) WHEN 2 THEN make_date(CAST(year(o_orderdate) AS INT), 12, 31) ELSE CAST(o_orderdate AS DATE) END AS hi,
      CASE l_linenumber % 5 WHEN 0 THEN 'Ki' WHEN 1 THEN 'IC50' WHEN 2 THEN 'Inhibition' WHEN 3 THEN 'AC50' ELSE 'EC50' END AS endpoint, CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN '<' ELSE '=' END AS relation,
      CASE l_partkey % 4 WHEN 0 THEN 'nM' WHEN 1 THEN 'uM' WHEN 2 THEN ' µM' ELSE '%' END AS unit, CASE l_partkey % 4 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e-6 WHEN 2 THEN 1e-6 END AS factor,
      CASE WHEN CAST(l_quantity AS INT) % 11 = 0 THEN 'n.d.' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS value, p_name, p_brand, p_type, p_size, l_orderkey, l_linenumber, l_partkey, l_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)),
prim AS (SELECT *, CASE WHEN tier[1] = 'A' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM ev WHERE tier[1] IN ('A', 'B'))"""
HIST = EV + f""",
hist AS (SELECT entity, target, pair_key, max(weight) AS weight, min(tier) AS tier FROM prim WHERE odate <= DATE '{CUTOFF}' GROUP BY ALL),
endp AS (SELECT entity AS query, target, min(tier) AS tier FROM prim WHERE odate > DATE '{CUTOFF}' AND pair_key NOT IN (SELECT pair_key FROM hist) GROUP BY ALL),
qs AS (SELECT DISTINCT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_mktsegment AS query FROM customer),
ts AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS target, p_name, p_brand, p_type, p_size FROM part)"""
SIM = HIST + """,
bits AS (SELECT DISTINCT entity, p_brand || '/' || p_size AS bit FROM hist JOIN ts USING (target)),
bn AS (SELECT entity, count(*) AS n FROM bits GROUP BY entity),
sim AS (SELECT a.entity AS query, b.entity AS entity, count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS similarity
  FROM bits a JOIN bits b USING (bit) JOIN bn x ON x.entity = a.entity JOIN bn y ON y.entity = b.entity GROUP BY ALL)"""
LED = SIM + f""",
pop AS (SELECT target, sum(weight) AS s FROM hist GROUP BY target),
fp AS (SELECT query, target, max(similarity * weight) AS s FROM sim JOIN hist USING (entity) GROUP BY ALL),
grid AS (SELECT query, target FROM qs CROSS JOIN ts WHERE (query, target) NOT IN (SELECT (entity, target) FROM hist)),
raw AS (SELECT '{scoring.POPULARITY}' AS baseline, query, target, round(coalesce(s, 0), 9) AS score FROM grid LEFT JOIN pop USING (target)
  UNION ALL SELECT '{scoring.FINGERPRINT}', query, target, round(coalesce(s, 0), 9) FROM grid LEFT JOIN fp USING (query, target)),
led AS (SELECT *, row_number() OVER (PARTITION BY baseline, query ORDER BY score DESC, substr(sha256('{SALT}|' || query || '|' || target), 1, 16), target) AS rank,
  count(*) OVER (PARTITION BY baseline, query) AS eligible FROM raw)"""
REL = LED + f""",
blocks AS (SELECT baseline, query, score, min(rank) AS "start", max(rank) AS "end", count(*) AS size FROM led GROUP BY ALL),
cold AS (SELECT e.*, p_type, p_size, p_type IN ('PROMO', 'SMALL', 'LARGE') AS pc FROM endp e JOIN ts USING (target)),
scoped AS (SELECT 'temporal' AS scope, * FROM cold UNION ALL SELECT 'scaffold_cold', * FROM cold WHERE pc
  UNION ALL SELECT 'joint_0.30', * FROM cold WHERE pc AND p_size > 35 UNION ALL SELECT 'joint_0.50', * FROM cold WHERE pc AND p_size > 20 UNION ALL SELECT 'joint_0.70', * FROM cold WHERE pc AND p_size > 20),
rel AS (SELECT l.baseline, s.scope, s.query, s.target, s.tier, l.rank, l.score FROM scoped s JOIN led l USING (query, target)),
pq AS (SELECT baseline, scope, query, count(*) AS relevant, count(*) FILTER (rank <= {K}) AS hits, 1.0 / min(rank) AS mrr, avg(CASE WHEN rank <= {K} THEN 1.0::DOUBLE ELSE 0 END) AS recall,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {K}), 0) / list_sum(list_transform(range(1, least({K}, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM rel GROUP BY ALL)"""
NAMES = HIST + """,
nm AS (SELECT DISTINCT p_name FROM part),
tf AS (SELECT p_name, substr(p_name, i, 3) AS gram, count(*) AS tf FROM (SELECT p_name, unnest(range(1, length(p_name) - 1)) AS i FROM nm) GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
gw0 AS (SELECT p_name, gram, tf * (ln((1 + (SELECT count(*) FROM nm)) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN df USING (gram)),
gw AS (SELECT p_name, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY p_name)) AS weight FROM gw0),
cs AS (SELECT a.p_name AS target, b.p_name AS other, sum(a.weight * b.weight) AS similarity FROM gw a JOIN gw b USING (gram) GROUP BY ALL),
nh AS (SELECT entity, p_name AS other, max(weight) AS weight FROM hist JOIN ts USING (target) GROUP BY ALL)"""

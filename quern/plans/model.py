"""A graph of facts over configured and auxiliary contexts, and everything derived from it.

Facts come in as DataFrames: nodes(id, kind, ...), edges(src, dst, kind, exact,
evidence, condition), roots(id, condition, aux_id), targets(name, platform,
entrypoint, flavor, dart_defines), aux_targets(id, environment_complete),
protections(id, reason), blockers(producer, reason, location, source_node_id,
affected_namespace, affected_node_ids). Contexts are few (tens), the facts are not.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.conditions import applies_to, applies_to_auxiliary
from quern.operators import closure as C
from quern.operators import findings
from quern.operators.facts import blockers as unique_blockers
from quern.plans.materialise import bounded, cut

BLOCKER = ["producer", "reason", "location", "source_node_id", "affected_namespace", "affected_node_ids"]


def context_id(name):
    """app:<name>, with the prefix not doubled."""
    return F.when(name.startswith("app:"), name).otherwise(F.concat(F.lit("app:"), name))


class Model:
    def __init__(self, nodes: DataFrame, edges: DataFrame, roots: DataFrame, targets: DataFrame, aux_targets: DataFrame, protections: DataFrame, blockers: DataFrame, registry_issues: DataFrame | None = None):
        self.nodes, self.roots, self.protections = nodes, roots, protections
        self.targets, self.aux_targets = bounded(targets), bounded(aux_targets)
        if self.targets.isEmpty():
            raise ValueError("at least one target is needed")
        if not self.targets.groupBy(context_id(F.col("name"))).count().where("count > 1").isEmpty():
            raise ValueError("target names and their context ids must be unique")
        self.edges, self._blockers, self.registry_issues = edges, blockers, registry_issues

    # Contexts and where facts apply.

    @cached_property
    def contexts(self) -> DataFrame:
        """context, domain, complete."""
        app = self.targets.select(context_id(F.col("name")).alias("context"), F.lit("configured").alias("domain"), F.lit(True).alias("complete"))
        aux = self.aux_targets.select(F.col("id").alias("context"), F.lit("auxiliary").alias("domain"), F.col("environment_complete").alias("complete"))
        return bounded(app.unionByName(aux))

    def _configured(self, facts: DataFrame) -> DataFrame:
        """facts and the configured contexts in which they apply."""
        t = self.targets.select(context_id(F.col("name")).alias("context"), *[F.col(c).alias(f"_{c}") for c in ("platform", "entrypoint", "flavor", "dart_defines")])
        yes = applies_to(F.col("condition"), F.col("context"), F.col("_platform"), F.col("_entrypoint"), F.col("_flavor"), F.col("_dart_defines"))
        return facts.join(bounded(t), yes).select("context", *facts.columns, F.lit("applies").alias("applicability"))

    @cached_property
    def _facts(self) -> DataFrame:
        return cut(self.edges)

    def _auxiliary(self, facts: DataFrame) -> DataFrame:
        """facts and the auxiliary contexts in which they may apply."""
        aux = bounded(self.aux_targets.select(F.col("id").alias("context")))
        seen = facts.join(aux).withColumn("applicability", applies_to_auxiliary(F.col("condition"), F.col("context"))).where("applicability <> 'does_not_apply'")
        return seen.select("context", *facts.columns, "applicability")

    @cached_property
    def edge_contexts(self) -> DataFrame:
        """Every edge once per context in which it may apply: applies or unknown."""
        return cut(self._configured(self._facts).unionByName(self._auxiliary(self._facts)))

    @cached_property
    def root_contexts(self) -> DataFrame:
        """context, id of the roots that apply."""
        return cut(self._rooted(self.roots).distinct())

    def _rooted(self, roots: DataFrame) -> DataFrame:
        app = self._configured(roots.where("aux_id is null").select("id", "condition")).select("context", "id")
        aux = roots.join(self.aux_targets.select(F.col("id").alias("aux_id")), "aux_id").select(F.col("aux_id").alias("context"), "id")
        return app.unionByName(aux)

    @cached_property
    def blockers(self) -> DataFrame:
        """The blockers, with one for the target of each edge whose condition an auxiliary context cannot decide."""
        none = F.lit(None).cast("string")
        unknown = self.edge_contexts.where("applicability = 'unknown'").select(
            F.lit("graph").alias("producer"), F.concat(F.lit("condition applicability unknown in "), "context").alias("reason"),
            none.alias("location"), none.alias("source_node_id"), none.alias("affected_namespace"), F.array("dst").alias("affected_node_ids"),
        )
        return cut(unique_blockers(self._blockers.select(*BLOCKER).unionByName(unknown)))

    # Closures.

    @cached_property
    def proven(self) -> DataFrame:
        """context, id. Auxiliary contexts whose environment is incomplete prove nothing, not even their roots."""
        complete = self.contexts.where("complete").select("context")
        edges = self.edge_contexts.where("exact and applicability = 'applies'").join(complete, "context", "left_semi")
        return C.closure(self.root_contexts.join(complete, "context", "left_semi"), edges, per_context=True)

    @cached_property
    def retained(self) -> DataFrame:
        """context, id: the fail-closed closure; auxiliary contexts also follow edges that may apply."""
        blockers = self.blockers.drop("recorded")
        return C.retained(self.root_contexts, self.edge_contexts, self.protections, blockers, self.nodes, self.contexts, per_context=True)

    @cached_property
    def reachable(self) -> DataFrame:
        """context, id of configured contexts: the compatibility closure.

        From the auxiliary roots, the context's own roots and the targets of edges out
        of retained nodes, over edges that apply in it or may in any auxiliary context.
        """
        app = self.contexts.where("domain = 'configured'").select("context")
        aux = self.contexts.where("domain = 'auxiliary'").select("context")
        may = self.edge_contexts.join(aux, "context", "left_semi").select("src", "dst").distinct()
        own = self.edge_contexts.join(app, "context", "left_semi").select("context", "src", "dst")
        edges = cut(own.unionByName(may.join(app).select("context", "src", "dst")).distinct())
        aux_roots = self.roots.where("aux_id is not null").select("id").distinct()
        kept_aux = self.retained.join(aux, "context", "left_semi").select("id").distinct().join(app).select("context", "id")
        kept = self.retained.join(app, "context", "left_semi").unionByName(kept_aux).distinct()
        out = kept.withColumnRenamed("id", "src").join(edges, ["context", "src"]).select("context", F.col("dst").alias("id"))
        seeds = self.root_contexts.join(app, "context", "left_semi").unionByName(aux_roots.join(app).select("context", "id")).unionByName(out)
        return C.closure(seeds, edges, per_context=True)

    # Integrity.

    @cached_property
    def integrity(self) -> DataFrame:
        """context, dangling_edges, dangling_roots, unknown_edges, complete; the row ``unattributed`` counts facts of no context.

        Whether a fact dangles does not depend on the context, so only those that do are dealt out over contexts.
        """
        known = self.nodes.select("id")
        identity = ["src", "dst", "kind", "_condition"]
        edges = self._facts.select("src", "dst", "kind", "condition")
        ends = [edges.join(known.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns) for end in ("src", "dst")]
        loose = cut(ends[0].unionByName(ends[1]).withColumn("_condition", F.to_json("condition")).dropDuplicates(identity))
        held_edges = cut(self._configured(loose).unionByName(self._auxiliary(loose)).select("context", *identity))
        per = held_edges.groupBy("context").agg(F.count("*").alias("dangling_edges"))
        loose_roots = cut(self.roots.join(known, "id", "left_anti").select("id", "condition", "aux_id"))
        roots = self._rooted(loose_roots).groupBy("context").agg(F.count_distinct("id").alias("dangling_roots"))
        unknown = self._auxiliary(edges).where("applicability = 'unknown'").groupBy("context").agg(F.count("*").alias("unknown_edges"))
        counts = ["dangling_edges", "dangling_roots", "unknown_edges"]
        rows = self.contexts.select("context").join(per, "context", "left").join(roots, "context", "left").join(unknown, "context", "left")
        attributed = held_edges.select(*[F.col(c).alias(f"h_{c}") for c in identity]).distinct()
        same = lambda c: F.col(c).eqNullSafe(F.col(f"h_{c}"))
        free = loose.join(attributed, same("src") & same("dst") & same("kind") & same("_condition"), "left_anti")
        of_app = loose_roots.where("aux_id is null").select("id", "condition")
        held = self._configured(of_app).select("id", F.to_json("condition").alias("_condition")).distinct()
        lost_app = of_app.select("id", F.to_json("condition").alias("_condition")).alias("r")
        lost_app = lost_app.join(held.alias("h"), (F.col("r.id") == F.col("h.id")) & F.col("r._condition").eqNullSafe(F.col("h._condition")), "left_anti").select("id")
        lost_aux = loose_roots.where("aux_id is not null").join(self.aux_targets.select(F.col("id").alias("aux_id")), "aux_id", "left_anti").select("id")
        lost = lost_app.unionByName(lost_aux).agg(F.count_distinct("id").alias("dangling_roots"))
        rest = free.agg(F.count("*").alias("dangling_edges")).join(lost).select(F.lit("unattributed").alias("context"), "dangling_edges", "dangling_roots", F.lit(0).cast("bigint").alias("unknown_edges"))
        out = rows.unionByName(rest).select("context", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
        return cut(out.withColumn("complete", F.expr(" + ".join(counts)) == 0))

    @cached_property
    def whole(self) -> bool:
        """Whether nothing is incomplete anywhere: no dangling fact, no undecided condition, no conflict of auxiliary targets."""
        return self.integrity.where("not complete").isEmpty() and (self.registry_issues is None or self.registry_issues.isEmpty())

    def violations(self) -> DataFrame:
        """context, id, problem: members that break proven within retained and, for configured contexts, within the compatibility closure."""
        app = self.contexts.where("domain = 'configured'").select("context")
        outside = lambda a, b, text: a.join(b, ["context", "id"], "left_anti").select("context", "id", F.lit(text).alias("problem"))
        mine = self.proven.join(app, "context", "left_semi")
        return outside(self.proven, self.retained, "proven, not retained").unionByName(outside(mine, self.reachable, "proven, not reachable"))

    # Findings.

    def active_blockers(self) -> DataFrame:
        """Blockers without a source, with one that is no node, or with one that any context retains."""
        blockers = self.blockers.drop("recorded")
        free = C.sourceless(blockers, self.nodes)
        kept = self.retained.select(F.col("id").alias("source_node_id")).distinct()
        known = self.nodes.select(F.col("id").alias("source_node_id")).distinct()
        bound = blockers.join(kept, "source_node_id", "left_semi").join(known, "source_node_id", "left_semi")
        return free.unionByName(bound.select(*free.columns))

    def blocked(self, nodes: DataFrame, blockers: DataFrame) -> DataFrame:
        """id of the nodes that the blockers address."""
        listed = blockers.select(F.explode("affected_node_ids").alias("id")).distinct()
        out = C.addressed(blockers, nodes).select("id").unionByName(nodes.join(listed, "id", "left_semi").select("id"))
        whole = blockers.where("affected_namespace is null and coalesce(size(affected_node_ids), 0) <= 0")
        return nodes.select("id") if not whole.isEmpty() else out.distinct()

    def findings(self, supported, external, coverage_complete: bool = True, package_mode: bool = False) -> DataFrame:
        """Unproven nodes with tier and reasons. Any incompleteness of the graph takes SAFE from all of them."""
        complete = self.whole
        rows = findings.candidates(self.nodes, self.proven, self.retained, self.protections, self.blocked(self.nodes, self.active_blockers()))
        return findings.classified(rows, supported, external, F.lit(coverage_complete), F.lit(complete), package_mode)

    def legacy_only(self) -> DataFrame:
        """id of nodes that only the compatibility closure reaches."""
        return self.reachable.select("id").distinct().join(self.retained.select("id").distinct(), "id", "left_anti")

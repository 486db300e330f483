"""The verbs of an episodic memory over one DataFrame of episodes.

Each verb returns a DataFrame and writes nothing; ``with_episodes`` makes a memory of a new snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.functions import render
from lumora.functions.utility import combined, confidence, share, wilson
from lumora.operators import duplicates, propagation, retrieval, store
from lumora.session import cut
from lumora.sources.files import Settings


@dataclass(frozen=True)
class Memory:
    """``episodes`` as slim rows (``schema.episodes``); ``as_of`` is the moment that ages are measured from."""

    episodes: DataFrame
    as_of: str
    settings: Settings = Settings()

    def with_episodes(self, episodes: DataFrame) -> Memory:
        return replace(self, episodes=episodes)

    @property
    def _now(self):
        return F.lit(self.as_of).cast("timestamp")

    def _of(self, project: str | None, mode: str = "equal_folded") -> DataFrame:
        return self.episodes.filter(store.project_matches(F.col("project"), project, mode)) if project else self.episodes

    def list(self, limit: int = 10, project: str | None = None, tag: str | None = None, outcome: str | None = None) -> DataFrame:
        return store.listed(self.episodes, project, tag, outcome, limit)

    def show(self, key: str) -> DataFrame:
        """One episode with its document: by the beginning of its id, or ``latest`` or ``last``."""
        found = store.latest(self.episodes) if key in ("latest", "last") else self.episodes.filter(F.startswith("id", F.lit(key))).orderBy(F.desc("started"), "id").limit(1)
        return found.withColumn("document", render.markdown())

    def stats(self, project: str | None = None) -> DataFrame:
        return store.statistics(self._of(project, "contains"))

    def status(self, project: str | None = None) -> DataFrame:
        e = self._of(project)
        w = wilson(F.col("helpful"), F.col("retrievals"))
        return e.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(store.is_unused(self._now)).alias("n_unused"), F.count_if(w > 0.4).alias("n_high_value"),
            F.coalesce(F.avg(w), F.lit(0.0)).alias("avg_utility"), share(F.sum("helpful"), F.sum("retrievals")).alias("feedback_rate"),
        )

    def _chosen(self, hits: DataFrame, limit: int | None, project: str | None) -> DataFrame:
        limit = limit or self.settings.default_limit
        near = hits.filter(F.col("similarity") >= self.settings.min_similarity)
        w = wilson(F.col("helpful"), F.col("retrievals"))
        e = self._of(project, "contains")
        scored = near.select("query_id", "id", "similarity").join(e, "id").withColumn("combined", combined(F.col("similarity"), w, self.settings.utility_weight))
        top = retrieval.best(scored, "query_id", "id", "combined", 2 * limit)
        text = F.concat_ws(" ", F.col("raw_prompt"), F.array_join("tags", " "), F.array_join("files", " "))
        picks = retrieval.diversified(top, "query_id", "id", "combined", text, limit)
        return picks.join(top.drop("hit_rank"), ["query_id", "id"]).withColumn("confidence", confidence(F.col("retrievals")))

    def retrieve_by_vector(self, queries: DataFrame, vectors: DataFrame, limit: int | None = None, project: str | None = None, dims: int = 384) -> DataFrame:
        """Varied hits of each (query_id, vector), by similarity and utility; ``vectors``: (id, vector).

        Only vectors of the project's episodes are searched, so a small project gets its hits as well as a large one.
        """
        if project:
            vectors = vectors.join(self._of(project, "contains").select("id"), "id", "left_semi")
        return self._chosen(retrieval.vector_hits(queries, vectors, 2 * (limit or self.settings.default_limit), dims), limit, project)

    def retrieve(self, queries: DataFrame, vectors: DataFrame, limit: int | None = None, project: str | None = None, dims: int = 384) -> DataFrame:
        """Hits of each (query_id, text, vector): by its vector, and by its words where the vector finds nothing."""
        near = cut(self.retrieve_by_vector(queries.select("query_id", "vector"), vectors, limit, project, dims))
        left = queries.select("query_id", "text").join(near.select("query_id").distinct(), "query_id", "left_anti")
        return near.unionByName(self.retrieve_by_text(left, limit, project))

    def retrieve_by_text(self, queries: DataFrame, limit: int | None = None, project: str | None = None) -> DataFrame:
        """The same by the words of (query_id, text)."""
        text = F.concat_ws(" ", F.col("raw_prompt"), F.col("intent"), F.array_join("tags", " "), F.array_join("files", " "))
        texts = self._of(project, "contains").select("id", text.alias("text"))
        return self._chosen(retrieval.text_hits(queries, texts, 2 * (limit or self.settings.default_limit), self.settings.min_similarity), limit, project)

    def feedback(self, verdicts: DataFrame) -> DataFrame:
        """A snapshot after (id, helpful): helpful counted, and the learned utility set to what the counters say.

        A verdict that is null is mixed and only counts as given; ids may be shortened.
        """
        given = verdicts.select(F.col("id").alias("key"), "helpful", F.lit(0).alias("seq"))
        return store.with_feedback(self.episodes, given).drop("last_helpful")

    def retrieved(self, log: DataFrame) -> DataFrame:
        """A snapshot after the retrievals (episode_id, ts): counters and last retrieval brought forward."""
        n = log.groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ts").cast("timestamp")).alias("at"))
        e = self.episodes.join(n, "id", "left")
        return e.withColumns({"retrievals": F.col("retrievals") + F.coalesce("n", F.lit(0)), "last_retrieval": F.greatest("last_retrieval", "at")}).select(*self.episodes.columns)

    def propagate(self, edges: DataFrame | None = None, temporal: bool = False) -> DataFrame:
        """A snapshot after decay and propagation over ``edges`` (by tags where there are none), and credit in time if wanted."""
        if edges is None:
            new = propagation.tag_propagated(self.episodes).select("id", F.col("new_learned").alias("learned"))
            decayed = propagation.decayed(self.episodes, self._now).withColumn("learned", F.when(F.col("decays"), F.col("new_learned")).otherwise(F.col("learned")))
            after = store.updated(decayed.select(*self.episodes.columns), new)
        else:
            after = propagation.propagated(self.episodes, edges, self._now).drop("changed_by")
        if temporal:
            after = store.updated(after, propagation.time_credited(after).select("id", F.col("new_learned").alias("learned")))
        return after

    def prune(self, max_age: int | None = None, min_utility: float | None = None) -> DataFrame:
        """What would be pruned; ``without(...)`` gives the snapshot."""
        return propagation.prunable(self.episodes, self._now, max_age, min_utility).filter("pruned")

    def without(self, keys: DataFrame) -> DataFrame:
        return store.deleted(self.episodes, keys)

    def review(self, project: str | None = None) -> DataFrame:
        """Groups of episodes that tell of the same work, with what would remain of each."""
        e = self._of(project)
        groups = duplicates.clusters(e.select("id", F.col("task_type").alias("part"), F.col("intent").alias("text")))
        return duplicates.consolidated(e, groups)

"""What the resolver's queries move and leave on the disks, on the small test tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from holdwright.plans import links, registered_resolution, resolver
from holdwright.plans.binding import EXPIRY_CUTOFF, DriverTables
from holdwright.session import checkpoint_dir
from holdwright.sources.store import Store


def tables(spark) -> set[str]:
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("table-")}


def test_late_observations_are_the_observations(spark, tiny):
    t = DriverTables(spark, tiny)
    assert t.late_observations.schema == t.observations.schema
    assert t.late_observations.exceptAll(t.observations).isEmpty() and t.observations.exceptAll(t.late_observations).isEmpty()


def test_texts_are_made_behind_the_move(spark, tiny):
    """No key of a holding is made below the exchange that brings line items and files together."""
    keyed = resolver.keyed_holdings(DriverTables(spark, tiny).late_corpus.observations)
    lines = keyed._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(lines) if "Join" in line and "file_id" in line)
    assert any("holding_key" in line for line in lines[:join]) and not any("holding_key" in line for line in lines[join:] if "Join" not in line)


def test_an_override_is_looked_up_for_names_that_have_one(spark, tiny):
    """The other holdings are neither written nor moved, and the picks are those of all holdings."""
    corpus, now = DriverTables(spark, tiny).corpus, F.lit(EXPIRY_CUTOFF).cast("date")
    before = tables(spark)
    got = registered_resolution.override_pick(spark, tiny)
    made = [spark.read.parquet(f"{checkpoint_dir(spark)}/{name}") for name in tables(spark) - before]
    names = resolver.overridden_names(corpus, now)
    assert made and all(t.join(names, "name_key", "left_anti").isEmpty() for t in made)
    keyed = resolver.keyed_holdings(corpus.observations)
    want = resolver.with_override(keyed, resolver.picked_overrides(keyed, corpus, now)).where("override_id IS NOT NULL").select("holding_key", "ties")
    assert not got.isEmpty() and want.exceptAll(got.select("holding_key", "ties")).isEmpty() and got.count() == want.count()


def test_a_run_leaves_its_result_alone(spark, tiny, tmp_path):
    """The run's own tables go; its counters and the stored state stay, and a run without anything new writes nothing."""
    corpus, now = DriverTables(spark, tiny).late_corpus, F.lit(EXPIRY_CUTOFF).cast("date")
    before = tables(spark)
    state = links.Resolution(Store(spark, str(tmp_path)), buckets=2)
    counters, _ = state.run(corpus, now, 1)
    assert tables(spark) == before
    want = resolver.run_summary(resolver.resolve(corpus, now)).first()
    assert counters.first() == want
    again, wrote = state.run(corpus, now, 2)
    assert not wrote["links"].written and not wrote["created"].written
    assert again.first().holdings_skipped_prelinked == want.holdings_skipped_prelinked + state.links.rows().where("entity_id IS NOT NULL").count()


def test_a_queue_needs_the_items_alone(spark, tiny):
    """Keyed holdings and picks go before the queue meets the holdings again."""
    before = tables(spark)
    rows = registered_resolution.queue_list(spark, tiny)
    left = [set(spark.read.parquet(f"{checkpoint_dir(spark)}/{name}").columns) for name in tables(spark) - before]
    assert not rows.isEmpty() and len(left) == 1 and "candidate_count" in left[0]

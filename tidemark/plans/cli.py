"""python -m tidemark.plans.cli JOB --data DIR --out DIR: jobs in the order of their dependencies."""

from __future__ import annotations

import argparse

from tidemark.plans import events as E
from tidemark.plans import markout as M
from tidemark.plans import quality as Q
from tidemark.session import build_session
from tidemark.sources.events import market
from tidemark.sources.files import ArtifactStore

JOBS = {
    "fast": {"event_study_quintile": E.event_study_quintile, "event_study_membership": E.event_study_membership, "adverse_selection": E.adverse_selection, "ic": M.ic_table, "psi": M.psi_table, "deciles": M.decile_table, "rules": M.rule_scores, "correlation": M.spearman_matrix},
    "markout": {"markout_baseline": M.markout_baseline},
    "quirks": {"liq_quirks": Q.liq_quirks, "bbo_quirks": Q.bbo_quirks, "gap_histogram": Q.gap_histogram, "burst_stats": Q.burst_stats, "burst_histogram": Q.burst_histogram, "daily_price": Q.daily_price},
    "micro": {"orderflow_acf": Q.orderflow_acf, "return_autocorr": Q.return_autocorr, "imbalance_ic": M.imbalance_ic, "price_offset": E.price_offset},
    "conditional": {"conditional_ic": M.conditional_ic, "conditional_means": M.conditional_means},
    "leadlag": {"leadlag_response": E.leadlag_response},
}
ON_SAMPLE = {"ic", "psi", "rules", "correlation", "conditional_ic", "conditional_means"}


def run(spark, data: str, out: str, job: str = "all", refresh: bool = False) -> list[str]:
    m, store, done = market(spark, data), ArtifactStore(spark, out), []
    wanted = JOBS if job == "all" else {job: JOBS[job]}
    names = [n for j in wanted.values() for n in j]
    sample = store.get_or_compute("feature_sample", lambda: M.feature_sample(m), refresh) if ON_SAMPLE & set(names) else None
    for jobs in wanted.values():
        for name, fn in jobs.items():
            store.get_or_compute(name, (lambda fn=fn: fn(m, sample=sample)) if name in ON_SAMPLE else (lambda fn=fn: fn(m)), refresh)
            done.append(store.path(name))
    return done


if __name__ == "__main__":
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("job", choices=[*JOBS, "all"])
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--refresh", action="store_true")
    x = a.parse_args()
    print("\n".join(run(build_session(), x.data, x.out, x.job, x.refresh)))

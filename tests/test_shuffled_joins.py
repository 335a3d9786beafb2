"""Tables with a row a compound, gene or hit are joined by shuffle: the files of a
million short rows are below Spark's threshold, but not what the driver would hold."""

import re

from pertscope import session
from pertscope.operators import enrichment as en
from pertscope.plans import confidence as cf
from pertscope.plans import gene_ranking as gr
from test_written_tables import _write

# bounded by the sizes of terms or by the blocks of compounds
SMALL = [r"\[n_genes#\d+L?, cast\(part", r"\[n_genes#\d+L?, part#", r"\[cb#"]


def test_grown_tables_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    _write(spark, tmp_path)
    plans = []
    write = session.materialize_rounds

    def told(spark, make, rounds, name="table"):
        plans.append((name, make(0)._jdf.queryExecution().sparkPlan().toString()))
        return write(spark, make, rounds, name)

    for module in (session, en, cf, gr):
        monkeypatch.setattr(module, "materialize_rounds", told)
    out = gr.recovery(spark, str(tmp_path))
    plans.append(("recovery", out._jdf.queryExecution().sparkPlan().toString()))
    assert {"unique-hits", "signatures", "confidence_raw", "enrichment_best_p", "enrichment_scores"} <= {name for name, _ in plans}
    sent = [(name, line.strip()) for name, plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert [x for x in sent if x[0] != "enrichment_scores" and not any(re.search(s, x[1]) for s in SMALL)] == []
    assert all("[compound#" not in line for name, line in sent)
    assert out.count() > 0

"""What an executed plan's nodes have counted."""


def nodes(df):
    """Runs the query; the nodes of its final plan as (name, {metric: value})."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    todo, out = [execution.executedPlan()], []
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        elif not name.startswith("Reused"):
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
        keys = plan.metrics().keys().toSeq()
        out.append((name, {keys.apply(i): plan.metrics().apply(keys.apply(i)).value() for i in range(keys.size())}))
    return out


def total(df, kind, metric):
    """Sum of a metric over the nodes whose name begins so."""
    return sum(m.get(metric, 0) for name, m in nodes(df) if name.startswith(kind))

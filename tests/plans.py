"""What a finished plan has done."""


def broadcast_bytes(plan):
    """Bytes of all tables that a finished plan has sent to the driver for a broadcast."""
    own = plan.metrics().apply("dataSize").value() if plan.nodeName() == "BroadcastExchange" else 0
    if plan.nodeName() == "AdaptiveSparkPlan":
        return broadcast_bytes(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return broadcast_bytes(plan.plan())
    children = plan.children()
    return own + sum(broadcast_bytes(children.apply(i)) for i in range(children.size()))

"""The lab writes a dozen tables on the way to a query; the driver may not keep the garbage of all of them."""

from proofmill.sources.shared import stored


def collections(spark):
    """Full collections of the driver's JVM so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_garbage_is_collected_after_each_table(spark):
    before = collections(spark)
    for n in range(1, 4):
        assert stored(spark.range(n), "garbage").count() == n
        assert collections(spark) >= before + n

"""Session helpers: checkpoint folder from the session, package shipping."""
from daycast import session


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getCheckpointDir()
    assert configured                                  # set by the test fixture
    assert session.checkpoint_dir(spark) == configured  # never replaced by a private one


def test_package_is_shipped_once(spark):
    session.ship_package(spark)
    before = set(session._SHIPPED)
    session.ship_package(spark)
    assert session._SHIPPED == before and spark.sparkContext.applicationId in before

    def probe(_):
        import daycast.operators.recursion as r
        return [r.MEAN_REVERSION]

    assert spark.sparkContext.parallelize([0], 1).mapPartitions(probe).collect() == [0.9]

import pytest

from lagfold.operators import reconstruct


def test_full_length(spark):
    dtraj = spark.createDataFrame([(0, t, s) for t, s in enumerate([0, 0, 1, 2, 1, 0])] + [(1, 0, 1)], "run_id long, t long, state int")
    kept = spark.createDataFrame([(0, 0, 0, 0.1, [1.0]), (0, 1, 0, 0.4, [2.0]), (0, 4, 1, 5.0, [3.0])], "run_id long, t long, state int, x double, xyz array<double>")
    centres = spark.createDataFrame([(0, 0.3), (1, 5.0), (2, 9.0)], "state int, x double")
    got = {(r.run_id, r.t): r.xyz[0] for r in reconstruct.full_length(dtraj, kept, centres, ["x"]).collect()}
    # state 0 is represented by t=1 (nearer to .3), state 2 has no kept frame and uses state 1's; kept frames are themselves
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (0, 3): 3.0, (0, 4): 3.0, (0, 5): 2.0, (1, 0): 3.0}
    bad = kept.withColumn("state", kept.state + 1)
    with pytest.raises(ValueError):
        reconstruct.full_length(dtraj, bad, centres, ["x"])

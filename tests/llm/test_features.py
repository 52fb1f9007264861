import numpy as np

from graphloom.llm import reading


def test_order_of_words_of_one_grade_does_not_count():
    rng = np.random.default_rng(5)
    grades, uses = rng.integers(1, 4, 60) / 1.0, rng.integers(1, 30, 60)
    place = np.lexsort((uses, grades))  # as the joined path and the calibration deliver them
    want = reading.features(grades[place], uses[place])
    for _ in range(20):
        p = rng.permutation(60)
        assert np.array_equal(reading.features(grades[p], uses[p]), want)
    assert np.array_equal(reading.features(np.array([1.0, 2.0, 2.0]), np.array([5, 9, 1])), reading.features(np.array([1.0, 2.0, 2.0]), np.array([5, 1, 9])))

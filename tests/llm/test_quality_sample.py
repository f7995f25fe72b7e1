from gaugeflow.llm import quality


def test_a_sampled_id_is_fitted_once(frame, monkeypatch):
    """However many rows have it; which of them does not depend on their order."""
    ids = [i for i in range(40)]
    rows = [(i, f"text number {i} " * 9) for i in ids] + [(3, f"copy {k} of three") for k in range(300)]
    rows += [(5, None)] * 20
    labels = frame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_attention", lambda bags, y: seen.append((bags, y)))
    for some in (rows, rows[::-1]):
        quality.fit(frame(some, "doc_id long, text string").repartition(3), labels)
    (bags, y), (again, _) = seen
    sampled = quality.labelled_sample(labels).count()
    assert 3 in {r._id for r in quality.labelled_sample(labels).collect()}
    assert len(bags) == len(y) == sampled
    assert all((a == b).all() for a, b in zip(bags, again))

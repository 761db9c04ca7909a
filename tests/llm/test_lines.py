"""Near copies of one template in the line dedup: which pairs of classes its join gives."""

import numpy as np

from tallyspark.llm import lines

from .test_operators import docs, similar_lines


def test_pairs_have_a_later_line_that_is_not_settled(spark, monkeypatch):
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(40)]
    variants = []
    for v in range(150):
        line = list(template)
        for k in rng.choice(40, 2, replace=False):
            line[k] = f"v{v}k{k}"
        variants.append(" ".join(line))
    # ids fall as files go on, so numbers of classes by partition are not in the order of places
    rows = [(100 - i, "\n".join(variants[i::50]), "a") for i in range(50)]
    saved, save = {}, lines.Workspace.save

    def keep(self, df, name):
        out = save(self, df, name)
        if name in ("reps", "settled", "pairs"):
            saved[name] = out.collect()
        return out

    monkeypatch.setattr(lines.Workspace, "save", keep)
    got = {(r["id"], n) for r in lines.repeated_lines(docs(spark, rows)).collect() for n in r["removed"]}
    assert got == similar_lines(rows) and got
    place = {r["r"]: (r["id"], r["line_no"]) for r in saved["reps"]}
    settled = {r["r"] for r in saved["settled"]}
    assert settled
    assert not [p for p in saved["pairs"] if max(p["a"], p["b"], key=place.get) in settled]

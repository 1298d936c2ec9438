import random
import tracemalloc

import numpy as np

from siftlog.llm import toxicity


def test_toxicity_fit_holds_only_features_that_count():
    """4 MB of text without repetition: nearly no feature counts, and the others must not be held."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=8000)) + (" vile" if n % 2 else " kind") for n in range(500)]
    tracemalloc.start()
    model = toxicity.fit(texts, np.arange(500) % 2, epochs=2)
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert peak < 280  # 209 measured; 418 when all features of the sample were held
    assert (toxicity.score_texts(["x vile", "x kind"], model) >= 0.5).tolist() == [True, False]

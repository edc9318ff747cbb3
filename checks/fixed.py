"""Fixed grade model shared by the Spark queries and their SQL."""

from __future__ import annotations

import numpy as np

from ledgerlens.config import GRADE_NAMES
from ledgerlens.operators.kmeans import ClusterModel

# Scaling and cluster centers (recency, frequency, monetary) of a
# known model, clusters in no particular order.
MEAN = (4.0, 1.0, 200000.0)
STD = (2.5, 1.0, 200000.0)
CENTERS = (
    (2.0, 2.2, 450000.0),
    (7.0, 0.0, 0.0),
    (1.2, 3.3, 750000.0),
    (3.5, 1.0, 110000.0),
    (2.5, 1.2, 270000.0),
)
# Grade by cluster number, poorest center first.
GRADES = (GRADE_NAMES[3], GRADE_NAMES[0], GRADE_NAMES[4], GRADE_NAMES[1], GRADE_NAMES[2])


def model(group: object = 0) -> ClusterModel:
    mean, std = np.array(MEAN), np.array(STD)
    return ClusterModel(group, len(CENTERS), mean, std, (np.array(CENTERS) - mean) / std)


def starts(k: int) -> list[tuple[float, float, float]]:
    """k centers on the line from a customer who is long gone to one who buys much."""
    return [(7.0 - 6.0 * j / (k - 1), 5.0 * j / (k - 1), 600000.0 * j / (k - 1)) for j in range(k)]

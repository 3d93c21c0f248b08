"""Encoders for tests: a layer is the samples cut into frames of 320, times the layer's number."""

import numpy as np


def layers(model):
    def run(samples):
        whole = np.resize(np.append(samples, np.zeros(-len(samples) % 320)), (-(-len(samples) // 320), 320))
        first = np.column_stack([whole.mean(axis=1), whole.std(axis=1)])
        return first if model == "hubert-soft" else [first * k for k in (1, 2, 3)]

    return run

"""The fit of the secret scanner's network takes candidates of any lengths without widening them."""

import numpy as np

from meshloom.llm import secretscan


def test_fit_of_ragged_rows_follows_the_loss():
    rows = [secretscan.encode("key = ", "a1B2" * k, " end") for k in (3, 5, 400)]
    y = np.array([1, 0, 1])
    net, start = secretscan.Network(), secretscan.Network()

    def loss(n):
        p = n.forward(secretscan.padded(rows))[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.fit(rows, y, epochs=1)  # Adam's first step follows the gradient's sign
    moved = 0
    for k in net.p:
        for at in list(np.ndindex(net.p[k].shape))[::37]:
            up, down = secretscan.Network(), secretscan.Network()
            up.p[k][at] += 1e-6
            down.p[k][at] -= 1e-6
            slope = (loss(up) - loss(down)) / 2e-6
            if abs(slope) > 1e-5:
                moved += 1
                assert np.isclose(net.p[k][at] - start.p[k][at], -0.01 * np.sign(slope), atol=1e-3)
    assert moved > 10

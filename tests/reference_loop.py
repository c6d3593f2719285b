"""A literal, single-machine statement of the greedy search semantics, used
only as the test oracle for the Spark plans (tiny inputs)."""


def greedy_reference(tokens, weights, bias, K, threshold, cap, rounds=None, skip_satisfied=False):
    x = list(tokens)
    L = len(x)
    z = bias + sum(weights[i * K + x[i]] for i in range(L))
    log, n, r, status = [], 0, 0, "working"
    if skip_satisfied and z >= threshold:
        return x, z, 0, "reached", log
    while rounds is None or r < rounds:
        r += 1
        best, best_gain = None, 0
        for i in range(L):
            for b in range(K):
                g = weights[i * K + b] - weights[i * K + x[i]]
                if g > best_gain:
                    best_gain, best = g, (i, x[i], b)
        if best is None:
            status = "stuck"
            break
        i, a, b = best
        x[i] = b
        z += best_gain
        log.append((n, i, a, b, z))
        n += 1
        if z >= threshold:
            status = "reached"
            break
        if n >= cap:
            status = "capped"
            break
    return x, z, n, status, log

"""Likelihood, marginals, joint maxima and samples of many sites at once (NumPy, no Spark).

All nodes of one height are handled together, and messages of siblings are summed as logarithms, so
neither deep trees nor nodes with many thousands of children underflow.  Arrays are
[node, category, site, state].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..functions.models import NucleotideModel, RateMixture, scaled_times, select_category, transitions
from ..functions.trees import Tree

#: Row m: which states the mask m allows.
EMISSION = np.array([[(m >> s) & 1 for s in range(4)] for m in range(16)], float)


#: Transition matrices of a tree are held if they take no more bytes; else they are worked out for some edges at a time, where they are used.
HELD_BYTES = 8 << 20
#: Edges times categories times sites (4 at least) that are worked off at a time.
BLOCK_CELLS = 1 << 18


@dataclass
class Problem:
    """A tree, a model and a mixture.  Only these travel to tasks; transition matrices are worked out there."""

    tree: Tree
    model: NucleotideModel
    mixture: RateMixture

    def __post_init__(self):
        self.model.validate()
        for c in range(self.mixture.count):
            scaled_times(self.model, self.tree.lengths, self.mixture.rate(c))
        self.log_weights = np.log([self.mixture.weight(c) for c in range(self.mixture.count)])
        with np.errstate(divide="ignore"):
            self.log_root = np.log(self.model.root)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "p"}

    @cached_property
    def p(self) -> np.ndarray:
        """[node, category, parent state, child state] of all nodes."""
        return self._transitions(self.tree.lengths)

    def _transitions(self, lengths: np.ndarray) -> np.ndarray:
        return np.stack([transitions(self.model, lengths, self.mixture.rate(c)) for c in range(self.mixture.count)], axis=1)

    def matrices(self, nodes: np.ndarray) -> np.ndarray:
        """[node, category, parent state, child state] of the edges into some nodes."""
        if self.tree.size * self.mixture.count * 128 <= HELD_BYTES:
            return self.p[nodes]
        return self._transitions(self.tree.lengths[nodes])

    def blocks(self, count: int, sites: int) -> Iterator[slice]:
        """Runs of edges that are worked off at a time."""
        size = max(1, BLOCK_CELLS // (self.mixture.count * max(4, sites)))
        return (slice(a, min(a + size, count)) for a in range(0, count, size))


def check_masks(masks: np.ndarray) -> None:
    if masks.size and (masks.min() < 1 or masks.max() > 15):
        raise ValueError("a mask is 1 to 15")


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _scaled(log_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of values less their maximum over states, and that maximum."""
    top = log_values.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    return np.exp(log_values - safe[..., None]), top


def _families(inner: np.ndarray, kids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each child the number of its parent among the inner nodes of a level, rising."""
    return np.repeat(np.arange(len(inner)), np.diff(np.r_[begins, len(kids)]))


def _gather(into: np.ndarray, family: np.ndarray, values: np.ndarray) -> None:
    """Adds values to those of their families, which rise."""
    first = np.flatnonzero(np.r_[True, family[1:] != family[:-1]])
    into[family[first]] += np.add.reduceat(values, first, axis=0)


def _ancestors(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """Whether a node is one of ``nodes`` or above one."""
    need = np.zeros(tree.size, bool)
    at = np.unique(nodes)
    while len(at):
        need[at] = True
        at = tree.parents[at]
        at = np.unique(at[at >= 0])
        at = at[~need[at]]
    return need


class _Parts:
    """Partial likelihoods by node, scaled to a maximum of 1; those of leaves are what was seen there and are not held."""

    def __init__(self, problem: Problem, masks: np.ndarray):
        self.seen, self.leaf = masks.T, problem.tree.heights == 0
        self.held = np.zeros((problem.tree.size, problem.mixture.count, masks.shape[0], 4))  # pages of leaves are never touched

    def emission(self, nodes: np.ndarray) -> np.ndarray:
        """[node, 1, site, state]"""
        return EMISSION[self.seen[nodes]][:, None]

    def __getitem__(self, nodes: np.ndarray) -> np.ndarray:
        """[node, category, site, state]"""
        out, leaf = self.held[nodes], self.leaf[nodes]
        if leaf.any():
            out[leaf] = self.emission(nodes[leaf])
        return out


def _log_messages(problem: Problem, parts: _Parts, at: np.ndarray) -> np.ndarray:
    """[child, category, site, parent state]: what some children say; leaves of one length that saw the same say the same."""
    k, s = problem.mixture.count, parts.seen.shape[1]
    leaf = parts.leaf[at]
    tips, rest = at[leaf], at[~leaf]
    _, first, number = np.unique(problem.tree.lengths[tips], return_index=True, return_inverse=True)
    if len(first) * 16 > len(tips) * s:
        return _log(np.matmul(parts[at], problem.matrices(at).swapaxes(-1, -2)))
    said = _log(np.matmul(EMISSION, problem.matrices(tips[first]).swapaxes(-1, -2)))  # [length, category, mask, parent state]
    said, which = said.swapaxes(0, 1).reshape(k, -1, 4), number[:, None] * 16 + parts.seen[tips]
    of_tips = np.stack([x.take(which, axis=0) for x in said]).swapaxes(0, 1)
    if not len(rest):
        return of_tips
    out = np.empty((len(at), k, s, 4))
    out[leaf] = of_tips
    out[~leaf] = _log(np.matmul(parts[rest], problem.matrices(rest).swapaxes(-1, -2)))
    return out


def upward(problem: Problem, masks: np.ndarray, keep: np.ndarray | None = None) -> dict:
    """masks [site, node] -> partial likelihoods, scaled to a maximum of 1, and the logarithms of the scales.

    ``keep`` says of each node whether its log message is asked for.
    """
    check_masks(masks)
    tree, k, s = problem.tree, problem.mixture.count, masks.shape[0]
    part = _Parts(problem, masks)
    scale = np.zeros((tree.size, k, s))
    log_messages = np.zeros(part.held.shape) if keep is not None else None
    for inner, kids, begins in tree.levels:
        family = _families(inner, kids, begins)
        product, below = np.zeros((len(inner), k, s, 4)), np.zeros((len(inner), k, s))
        for some in problem.blocks(len(kids), s):
            at = kids[some]
            message = _log_messages(problem, part, at)
            if keep is not None:
                log_messages[at[keep[at]]] = message[keep[at]]
            _gather(product, family[some], message)
            grown = ~part.leaf[at]
            if grown.any():
                _gather(below, family[some][grown], scale[at[grown]])
        part.held[inner], top = _scaled(product + _log(part.emission(inner)))
        scale[inner] = below + top
    top = np.array([tree.root])
    root = _log((part[top][0] * problem.model.root).sum(-1)) + scale[tree.root]  # [category, site]
    joint = root + problem.log_weights[:, None]
    return {"part": part, "scale": scale, "log_messages": log_messages, "by_category": joint, "log_likelihood": np.logaddexp.reduce(joint, axis=0)}


def log_likelihoods(problem: Problem, masks: np.ndarray) -> np.ndarray:
    """Per site; -inf for a site that cannot occur."""
    return upward(problem, masks)["log_likelihood"]


def _but_own(message: np.ndarray, begins: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Per child, the sum of its siblings' log messages, where any may be -inf."""
    none = np.isneginf(message)
    finite = np.where(none, 0.0, message)
    total, zeros = np.add.reduceat(finite, begins, axis=0)[family], np.add.reduceat(none.astype(np.int64), begins, axis=0)[family]
    return np.where(zeros - none > 0, -np.inf, total - finite)


def marginals(problem: Problem, masks: np.ndarray, nodes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """node [site, node, state], edge [site, node, parent state, child state] (of the edge into the node),
    category [site, category], log_likelihood [site], averaged over categories; NaN where a site cannot occur.

    ``nodes`` are those that node and edge are of, in this order; only what lies above them is worked out on the way down.
    """
    tree = problem.tree
    nodes = np.arange(tree.size) if nodes is None else np.asarray(nodes)
    wanted = np.unique(nodes)
    k, s = problem.mixture.count, masks.shape[0]
    need = _ancestors(tree, wanted)
    parents = np.zeros(tree.size, bool)
    parents[tree.parents[need & (tree.parents >= 0)]] = True
    up = upward(problem, masks, keep=(tree.parents >= 0) & parents[tree.parents])  # the siblings of those that are needed
    ll = up["log_likelihood"]
    with np.errstate(invalid="ignore"):
        category = np.exp(up["by_category"] - ll)  # [category, site]
    held = np.flatnonzero(need)  # the nodes whose outside is held
    outside = np.zeros((len(held), k, s, 4))
    outside[np.searchsorted(held, tree.root)] = problem.model.root
    node, edge = np.zeros((s, len(wanted), 4)), np.zeros((s, len(wanted), 4, 4))

    def averaged(joint: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        total = joint.sum(axis=axes, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = joint / total
        shape = [1, k, s] + [1] * len(axes)
        return (share * category.reshape(shape)).sum(axis=1)

    top = wanted == tree.root
    if top.any():
        node[:, top] = averaged(problem.model.root * up["part"][wanted[top]], (-1,)).transpose(1, 0, 2)
    for inner, kids, begins in reversed(tree.levels):
        family = _families(inner, kids, begins)
        asked = np.zeros(len(inner), bool)
        asked[family[need[kids]]] = True  # families of which a child is needed; all its siblings count
        kids, family = kids[asked[family]], family[asked[family]]
        if not len(kids):
            continue
        own = need[kids]
        begins = np.flatnonzero(np.r_[True, family[1:] != family[:-1]])
        rest_of = _but_own(up["log_messages"][kids], begins, np.cumsum(np.r_[False, family[1:] != family[:-1]]))[own]
        kids, family = kids[own], family[own]
        for some in problem.blocks(len(kids), s):
            at, of = inner[family[some]], kids[some]
            p = problem.matrices(of)
            rest, _ = _scaled(_log(outside[np.searchsorted(held, at)]) + _log(up["part"].emission(at)) + rest_of[some])
            below = np.matmul(rest, p)
            most = below.max(axis=-1, keepdims=True)
            outside[np.searchsorted(held, of)] = below / np.where(most > 0, most, 1.0)
            place = np.minimum(np.searchsorted(wanted, of), len(wanted) - 1)
            mine = wanted[place] == of
            joint = rest[mine][..., :, None] * p[mine][:, :, None] * up["part"][of[mine]][..., None, :]  # [kid, k, s, parent, child]
            edge[:, place[mine]] = averaged(joint, (-2, -1)).transpose(1, 0, 2, 3)
    node[:, ~top] = edge[:, ~top].sum(axis=2)
    if len(nodes) != len(wanted) or (nodes != wanted).any():
        back = np.searchsorted(wanted, nodes)
        node, edge = node[:, back], edge[:, back]
    return {"node": node, "edge": edge, "category": category.T, "log_likelihood": ll}


def online_marginals(problem: Problem, masks: np.ndarray, nodes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """node, edge and log_likelihood of marginals(), category by category with the arrays of one held at a time.

    What has been added up is kept as if its own likelihood were the whole, and is scaled down when the next category joins.
    """
    total = np.full(masks.shape[0], -np.inf)
    node = edge = None
    for c in range(problem.mixture.count):
        one = marginals(Problem(problem.tree, select_category(problem.model, problem.mixture, c), RateMixture()), masks, nodes)
        own = one["log_likelihood"] + problem.log_weights[c]
        after = np.logaddexp(total, own)
        with np.errstate(invalid="ignore"):
            before, new = (np.where(np.isneginf(x), 0.0, np.exp(x - after)) for x in (total, own))
        alive = ~np.isneginf(own)
        if node is None:
            node, edge = np.zeros_like(one["node"]), np.zeros_like(one["edge"])
        for kept, part in ((node, one["node"]), (edge, one["edge"])):
            shape = (-1,) + (1,) * (part.ndim - 1)
            kept *= before.reshape(shape)
            kept[alive] += part[alive] * new[alive].reshape(shape)
        total = after
    dead = np.isneginf(total)
    node[dead], edge[dead] = np.nan, np.nan
    return {"node": node, "edge": edge, "log_likelihood": total}


def joint_maximum(problem: Problem, masks: np.ndarray) -> dict[str, np.ndarray]:
    """states [site, node], category [site], log_weight [site]: the most probable joint assignment.

    Ties go to the smaller state and the smaller category; a site that cannot occur has states and category -1 and -inf.
    """
    check_masks(masks)
    tree = problem.tree
    s = masks.shape[0]
    log_emission = _log(EMISSION[masks.T])[:, None]
    best = np.broadcast_to(log_emission, (tree.size, problem.mixture.count, s, 4)).copy()
    choice = np.zeros(best.shape, np.int8)
    for inner, kids, begins in tree.levels:
        family, product = _families(inner, kids, begins), np.zeros((len(inner), *best.shape[1:]))
        for some in problem.blocks(len(kids), s):
            at = kids[some]
            through = _log(problem.matrices(at))[:, :, None] + best[at][..., None, :]  # [kid, k, s, parent, child]
            choice[at] = through.argmax(axis=-1)
            _gather(product, family[some], through.max(axis=-1))
        best[inner] = product + log_emission[inner]
    at_root = best[tree.root] + problem.log_root
    weight = at_root.max(axis=-1) + problem.log_weights[:, None]
    category = weight.argmax(axis=0)
    sites = np.arange(s)
    states = np.zeros((tree.size, s), np.int64)
    states[tree.root] = at_root[category, sites].argmax(axis=-1)
    for _, kids, _ in reversed(tree.levels):
        states[kids] = choice[kids[:, None], category, sites, states[tree.parents[kids]]]
    log_weight = weight[category, sites]
    dead = np.isneginf(log_weight)
    states[:, dead], category = -1, np.where(dead, -1, category)
    return {"states": states.T, "category": category, "log_weight": log_weight}


def _draw(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """First state whose running sum exceeds the draw, else the last that is possible."""
    upto = np.cumsum(p, axis=-1)
    hit = u[..., None] * upto[..., -1:] < upto
    last = p.shape[-1] - 1 - (p[..., ::-1] > 0).argmax(axis=-1)
    return np.where(hit.any(axis=-1), hit.argmax(axis=-1), last)


def posterior_sample(problem: Problem, masks: np.ndarray, uniforms: np.ndarray, category_uniforms: np.ndarray | None = None, nodes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """states [site, node] and category [site] drawn from the posterior; uniforms [site, node] in [0, 1).

    ``nodes`` are those whose states are returned, in this order; only they and what lies above them is drawn.
    """
    if ((uniforms < 0) | (uniforms >= 1)).any():
        raise ValueError("uniforms must be in [0, 1)")
    tree, up = problem.tree, upward(problem, masks)
    s = masks.shape[0]
    sites = np.arange(s)
    category = np.zeros(s, np.int64)
    need = np.ones(tree.size, bool) if nodes is None else _ancestors(tree, nodes)
    with np.errstate(invalid="ignore"):
        if problem.mixture.count > 1:
            category = _draw(np.exp(up["by_category"] - up["log_likelihood"]).T, category_uniforms)
        states = np.zeros((tree.size, s), np.int8)
        states[tree.root] = _draw(problem.model.root * up["part"].held[tree.root, category, sites], uniforms[:, tree.root])
        for _, kids, _ in reversed(tree.levels):
            kids = kids[need[kids]]
            for some in problem.blocks(len(kids), s):
                at = kids[some]
                p = problem.matrices(at)[np.arange(len(at))[:, None], category, states[tree.parents[at]]]  # [kid, site, child state]
                states[at] = _draw(p * up["part"][at][np.arange(len(at))[:, None], category, sites], uniforms[:, at].T)
    dead = np.isneginf(up["log_likelihood"])
    states = (states if nodes is None else states[nodes]).astype(np.int64)
    states[:, dead], category[dead] = -1, -1
    return {"states": states.T, "category": category, "log_likelihood": up["log_likelihood"]}


def assignment_log_weight(problem: Problem, states: np.ndarray, category: np.ndarray) -> np.ndarray:
    """Log weight of full assignments, with the category's."""
    tree = problem.tree
    out = problem.log_weights[category] + problem.log_root[states[:, tree.root]]
    kids = tree.topological[1:]
    for some in problem.blocks(len(kids), states.shape[0]):
        at = kids[some]
        out = out + _log(problem.matrices(at))[np.arange(len(at))[:, None], category, states[:, tree.parents[at]].T, states[:, at].T].sum(axis=0)
    return out

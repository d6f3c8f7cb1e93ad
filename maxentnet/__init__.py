"""Networks as tables: graphs, their marginals, and maximum-entropy models of them, as DataFrame plans."""

from maxentnet.operators.algorithms import pagerank, trophic_depth
from maxentnet.operators.conditional import ConditionalInvariantModel
from maxentnet.operators.fitness import FitnessModel, ScaleInvariantModel
from maxentnet.operators.graph import DiGraph, Graph, MultiDiGraph, MultiGraph
from maxentnet.operators.multi import MultiFitnessModel, MultiInvariantModel
from maxentnet.operators.random import RandomDiGraph
from maxentnet.operators.solver import Solution, monotonic_newton_solver

__all__ = ["ConditionalInvariantModel", "DiGraph", "FitnessModel", "Graph", "MultiDiGraph", "MultiFitnessModel", "MultiGraph", "MultiInvariantModel", "RandomDiGraph", "ScaleInvariantModel", "Solution", "monotonic_newton_solver", "pagerank", "trophic_depth"]

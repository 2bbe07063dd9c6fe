from .flows import Flow, IncidentSpec, forest_flow, mlp_flow, tree_flow

__all__ = ["Flow", "IncidentSpec", "forest_flow", "mlp_flow", "tree_flow"]

from .incidents import INCIDENT_FIELDS, INCIDENT_TIME, read_incidents, rejected_cells, union_years
from .sinks import write_results

__all__ = ["INCIDENT_FIELDS", "INCIDENT_TIME", "read_incidents", "rejected_cells", "union_years", "write_results"]

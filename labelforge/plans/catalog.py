"""All registered queries, grouped by blueprint family.

Import order matters only for the registry's insertion order.
"""

from labelforge.plans import q_consensus  # noqa: F401
from labelforge.plans import q_text  # noqa: F401
from labelforge.plans import q_metrics  # noqa: F401
from labelforge.plans import q_teacher  # noqa: F401
from labelforge.plans import q_cost  # noqa: F401
from labelforge.plans import q_io  # noqa: F401
from labelforge.plans import q_vectors  # noqa: F401

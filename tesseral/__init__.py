"""Row-addressed hierarchical datasets on Spark."""

from .enums import Enum
from .operators.arrays import NdArray, RaggedArray
from .operators.expr import Expr
from .operators.table import Table
from .sources.catalog import Store, copy_store, is_store, open_store
from .sources.filters import Filters
from .types import Col, Description, Record

__all__ = ["Col", "Description", "Enum", "Expr", "Filters", "NdArray", "RaggedArray", "Record", "Store", "Table", "copy_store", "is_store", "open_store"]

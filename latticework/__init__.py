"""An OLAP cube engine on Spark: multidimensional models over star and snowflake tables, and views
that compile to single DataFrame plans."""

from .model import ALL, CubeModel, Dimension, ForeignKey, Level, ModelError, StoredMeasure
from .operators.members import Member, MemberSet, NoSuchMember
from .operators.view import View
from .session import Cube, CubeSession

__all__ = ["ALL", "Cube", "CubeModel", "CubeSession", "Dimension", "ForeignKey", "Level", "Member", "MemberSet", "ModelError", "NoSuchMember", "StoredMeasure", "View"]

"""Names of the columns that identify one panel row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Keys:
    """Entity and week columns of a panel. A panel holds one row per entity and week."""

    entity: str = "entity_id"
    year: str = "year"
    week: str = "epi_week"

    @property
    def time(self) -> list[str]:
        return [self.year, self.week]

    @property
    def panel(self) -> list[str]:
        return [self.entity, self.year, self.week]

    def series(self, *extra: str) -> WindowSpec:
        """The one ordered window all lag/lead features share.

        A group holds at most one row per calendar week, so its size is bounded by the
        length of the calendar however many source rows an entity has.
        """
        return Window.partitionBy(self.entity, *extra).orderBy(self.year, self.week)


DEFAULT_KEYS = Keys()

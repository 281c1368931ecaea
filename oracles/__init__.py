"""Expected results as SQL over the base tables, by query name."""

from oracles import models, operators, reports, series

SQL = {**reports.SQL, **operators.SQL, **series.SQL, **models.SQL}

"""Physical plans as text, for tests that look at them."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

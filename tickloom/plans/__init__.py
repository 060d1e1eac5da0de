from importlib import import_module

GROUPS = ["market_data", "research", "modelling", "live"]


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in GROUPS:
        import_module(f"tickloom.plans.{name}")

"""The driver's tables seen as event data, with one query and one SQL oracle per operator."""

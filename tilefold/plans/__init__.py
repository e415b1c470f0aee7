"""Query plans that the driver registers, and plan building blocks."""

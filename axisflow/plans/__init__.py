"""Multi-step plans composed of the operators."""

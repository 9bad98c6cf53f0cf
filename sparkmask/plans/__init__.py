"""Configuration models, the compiler with its checks, and the runner."""

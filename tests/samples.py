"""Sample texts that several tests share."""

PYTHON_MAIN = '''"""Main module for a sample."""

def total(a: int, b: int) -> int:
    """Sum two numbers.

    This function always returns the right sum.
    """
    return a + b

def many(a, b, c, d, e, f, g):
    return a

class Calculator:
    """A calculator."""

    def __init__(self):
        try:
            self.result = 0
        except:  # everything
            pass
'''

README = """# Sample

This project provides a simple calculator with these features:

- **Fast calculations**: Can handle up to 1000 operations per second
- **Secure**: No security vulnerabilities

## API

The `total` function always returns the right sum.

```python
result = total(2, 3)
obj.process(data)
```

See `a.b`, `run()`, `class Foo` and `docs/x.md`.
"""
